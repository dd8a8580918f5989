"""What a host repeats: on few of its pages it is prose, on many a template; sentences stay whole."""

import random

from codeloom.llm.html import main_text

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return {r.id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_phrases_and_copies_on_a_large_host_stay(spark):
    draw = random.Random(2)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    menu, phrase, story = "Home News Sport Weather Contact us", "at the end of the day", text(40)
    said = [f"{text(6)} {phrase} {text(6)}" if i < 4 else story if i < 8 else text(20) for i in range(60)]
    pages = [f"<div>{menu}</div><div>{s}</div><div>{text(9)} {menu}</div>" for s in said]
    got = texts(spark, pages + pages[-1:] * 9)
    assert all(got[i].split("\n\n")[0] == s and got[i].endswith(menu) and got[i].count("\n\n") == 1 for i, s in enumerate(said))
    assert got[60] == got[68] == got[59]


def test_repeated_contents_count_once(spark):
    pages = [f"<div>one passage of six words here</div><div>page {c} of all</div>" for c in "aabbccc"]
    other = texts(spark, pages[:4])
    assert all("one passage" in t for t in other.values())
    assert not any("one passage" in t for t in texts(spark, pages).values())


def test_template_lines_inside_articles_go(spark):
    draw = random.Random(4)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    share, quote, copied = "Send this to a friend", text(30), [text(20), text(30)]
    bodies = [[text(25), quote] if i < 4 else [text(25)] for i in range(12)]
    bodies = [[*b, share] for b in bodies] + [copied] * 15
    pages = [f"<article>{''.join(f'<p>{p}</p>' for p in b)}</article><footer>page {i}</footer>" for i, b in enumerate(bodies)]
    got = texts(spark, pages)
    assert got == {i: "\n\n".join(p for p in b if p != share) for i, b in enumerate(bodies)}
