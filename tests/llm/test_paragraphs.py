"""Repeated paragraphs: pasted passages, similar lines, the first copy stays, clean texts stay whole."""

import hashlib
import random

import numpy as np

from codeloom.llm import paragraphs
from codeloom.llm.common import shingles


def words(draw, n):
    return ["".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(3, 8))) for _ in range(n)]


def test_line_signatures_match_those_of_each_line():
    draw = random.Random(1)
    data = "\n".join(" ".join(words(draw, draw.randint(0, 40)) * draw.randint(1, 2)) for _ in range(30)).encode()
    start, end, line = paragraphs.words_of(data)
    own = paragraphs.hashes_of(data, start, end)
    lo, hi, n, _, _, bands = paragraphs.lines_of(own, line, start, end)
    for i in range(len(lo)):
        part = data[lo[i] : hi[i]]
        found = np.unique(shingles(paragraphs.hashes_of(part, *paragraphs.words_of(part)[:2]), 5))
        assert len(found) <= n[i] and (paragraphs.SCHEME.keys(found) == bands[i]).all()


def test_equal_words_have_equal_hashes_across_blocks():
    draw = random.Random(2)
    known = words(draw, 4000)
    long = "z" * (paragraphs.BLOCK + 5)
    parts = [draw.choice(known) for _ in range(40_000)] + ["A\0", "a", "a\0\0", "\0", "É", "é", long, long + "z", long.upper()]
    draw.shuffle(parts)
    hash_of = {}
    for data in (" ".join(parts).encode(), b"\t\n" + " \r".join(reversed(parts)).encode() + b"\x0b", b"", b" \n ", b"one"):
        start, end, _ = paragraphs.words_of(data)
        found, expected = paragraphs.hashes_of(data, start, end).tolist(), data.lower().split()
        assert len(found) == len(expected)
        assert all(hash_of.setdefault(w, h) == h for w, h in zip(expected, found))
    assert len(set(hash_of.values())) == len(hash_of) > 3800  # short random words repeat


def test_fetched_lines_have_the_keys_of_their_texts(spark):
    draw = random.Random(4)
    lines = [" ".join(words(draw, draw.randint(paragraphs.LINE, 60))) for _ in range(3000)] + ["É\x0bb\x0c " * 9]
    rows = spark.createDataFrame(list(enumerate(lines)), "id bigint, text string").repartition(3)
    got = {r.id: r for r in paragraphs.line_bands(rows).collect()}
    data = "\n".join(lines).encode()
    start, end, line = paragraphs.words_of(data)
    bands = paragraphs.lines_of(paragraphs.hashes_of(data, start, end), line, start, end)[5]
    assert len(got) == len(lines) == len(bands)
    assert all(got[i].text == lines[i] and got[i].bands == bands[i].tolist() for i in range(len(lines)))


def test_passages_lines_and_odd_rows(spark):
    draw = random.Random(8)
    text = lambda n: " ".join(words(draw, n))
    passage, line = text(70), words(draw, 60)
    near = list(line)
    near[59] = "different"
    docs = {
        10: text(40) + " " + passage + " " + text(30),
        11: text(25) + " " + passage + " " + text(8) + "\n" + text(20),
        12: "short line\n" + " ".join(line),
        13: "short line\n" + " ".join(near) + "\n" + text(30),
        14: text(200),
        15: "",
        16: None,
        17: "short line",
    }
    rows = [(k, v, "clash") for k, v in docs.items()] + [(14, docs[14], "clash"), (None, docs[10], "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lines string").repartition(4)
    got = {}
    for r in paragraphs.repeated_paragraphs(df).collect():
        got.setdefault(r.id, []).append(r)
    removed = {k: [(r.n_bytes, r.n_removed) for r in v] for k, v in got.items()}
    assert all(removed[k][0][1] == 0 for k in (10, 12, 14, 15, 16, 17)) and len(removed[14]) == 2
    assert removed[11][0][1] == len(passage)
    assert removed[13][0][1] == len("short line\n" + " ".join(near))  # its neighbour stands before, too
    assert removed[None][0][1] == len(docs[10])
    for k in (11, 13):
        data, at, kept = docs[k].encode(), 0, b""
        for s in got[k][0].spans:
            kept, at = kept + data[at : s.lo], s.hi
        assert got[k][0].kept_sha256 == hashlib.sha256(kept + data[at:]).hexdigest()
    assert paragraphs.repeated_paragraphs(df.limit(0)).count() == 0


def test_texts_that_share_a_run_share_an_anchor():
    draw = random.Random(3)

    def hashes(row):
        data = " ".join(row).encode()
        return paragraphs.hashes_of(data, *paragraphs.words_of(data)[:2])

    for _ in range(300):
        shared, n = words(draw, paragraphs.RUN), draw.randrange(40)
        one, other = words(draw, n) + shared + words(draw, 5), words(draw, draw.randrange(3)) + shared + words(draw, draw.randrange(30))
        (a, at), (b, _) = paragraphs.anchors_of(hashes(one)), paragraphs.anchors_of(hashes(other))
        both = np.isin(a, b)
        assert both.any() and ((at[both] >= n) & (at[both] <= n + paragraphs.RUN)).any()
    assert len(paragraphs.anchors_of(hashes(words(draw, 20_000)))[0]) < 20_000 * 0.22
    assert len(paragraphs.anchors_of(hashes(["z"] * 5000))[0]) == 1


def test_recall_inside_lines(spark):
    """Bytes of a passage removed from its second place, amid 100 other words on either side, in one line."""
    draw, rows, passages = random.Random(5), [], {}
    for kind, (size, changed) in enumerate([(20, 0), (30, 0), (50, 0), (100, 0), (100, 3), (19, 0)]):
        for i in range(40):
            passage = words(draw, size)
            edited = list(passage)
            for k in draw.sample(range(size), changed):
                edited[k] = "edited"
            key = kind * 1000 + 2 * i
            passages[key + 1] = (kind, len(" ".join(edited)))
            rows += [(k, " ".join(words(draw, 100) + p + words(draw, 100))) for k, p in ((key, passage), (key + 1, edited))]
    found = {r.id: r.n_removed for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(n == 0 for k, n in found.items() if k not in passages)  # first copies stay whole
    share = [0.0] * 6
    for k, (kind, size) in passages.items():
        share[kind] += found[k] / size / 40
    share = [round(x, 9) for x in share]
    assert share[:4] == [1.0] * 4 and share[4] > 0.9 and share[5] == 0.0


def plain(docs, run):
    """id -> words of repeated runs: word places covered by ``run`` equal words that stand in an earlier text or place."""
    seen, gone = {}, {}
    for k in sorted(docs):
        own = docs[k].lower().split()
        gone[k] = set()
        for i in range(len(own) - run + 1):
            piece = tuple(own[i : i + run])
            if piece in seen:
                gone[k] |= set(range(i, i + run))
            else:
                seen[piece] = k
    return gone


def test_exact_runs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "LINE", 1 << 30)  # runs of words only
    draw = random.Random(11)
    pool = [words(draw, draw.randint(20, 60)) for _ in range(12)]
    docs = {}
    for k in range(60):
        text = []
        for _ in range(draw.randint(0, 4)):
            text += words(draw, draw.randint(0, 30)) + (draw.choice(pool) if draw.random() < 0.7 else [])
        docs[k] = " ".join(text)
    docs[60], docs[61] = docs[5], " ".join(words(draw, 30) * 5)
    long = words(draw, 300_000)
    docs[62] = " ".join(long) + "\n" + " ".join(pool[0])
    docs[63] = " ".join(long[1000:250_000])
    expected = plain(docs, paragraphs.RUN)
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id long, text string").repartition(5)
    wrong = 0
    for r in paragraphs.repeated_paragraphs(df).collect():
        data, own = docs[r.id].encode(), set()
        start, end, _ = paragraphs.words_of(data)
        for s in r.spans:
            own |= set(np.flatnonzero((start >= s.lo) & (end <= s.hi)).tolist())
        assert own <= expected[r.id]
        wrong += len(expected[r.id] - own)
    assert wrong <= 0.01 * sum(map(len, expected.values())) and sum(map(len, expected.values())) > 250_000


def test_texts_worked_out_together_equal_each_alone():
    draw = random.Random(5)
    sizes = [0, 1, 11, 12, 13, 19, 20, 21, 0, 40, 5000, 14, 0] * 4
    texts = [" ".join(words(draw, n)).encode() for n in sizes]
    texts += [b" \n ", b"x " * 60, b"y", texts[9] + b"\n" + texts[9], texts[9]] + [b"a b"] * 9
    draw.shuffle(texts)
    for group in (texts, texts[:3], texts[:1], [b""], [b"one two"]):
        sha, again, n_lines, lines, n_anchors, anchors = paragraphs.parts_of(group)
        for i, data in enumerate(group):
            start, end, line = paragraphs.words_of(data)
            own = paragraphs.hashes_of(data, start, end)
            value, at, later, _ = paragraphs.distinct_anchors(own)
            part = slice(sum(n_anchors[:i]), sum(n_anchors[: i + 1]))
            assert (anchors[0][part] == value).all() and (anchors[1][part] == at).all() and len(value) == n_anchors[i]
            assert again[i] == (len(later) > 0) and sha[i] == hashlib.sha256(data).hexdigest()
            alone = paragraphs.lines_of(own, line, start, end) if len(own) else None
            assert n_lines[i] == (len(alone[0]) if alone else 0)
            part = slice(sum(n_lines[:i]), sum(n_lines[: i + 1]))
            assert alone is None or all(np.array_equal(a, b[part]) for a, b in zip(alone, lines))
