"""A code corpus whose expected analysis is known, derived row by row from ``documents``.

A file is a template followed by the whole text of its document, as line comments of its language
(as plain text after prose), so every text is read, stripped and parsed.
"""

from pyspark.sql import functions as F

# Document ``d`` becomes TEMPLATES[d % 27] with {id} replaced by d.
TEMPLATES = [
    "def f_{id}(x):\n    return x + 1\n",
    "import os, sys\nv_{id} = os.sep\n",
    "from pickle import loads, dumps\nv_{id} = 1\n",
    "import pickle\nv_{id} = 2\n",
    "def g_{id}():\n    try:\n        pass\n    except:\n        pass\n",
    "import io\ntry:\n    v_{id} = 1\nfinally:\n    pass\n",
    "import re\nv_{id} = eval('1 + 1')\n",
    "import re\nv_{id} = re.x.eval(3)\nexec('v = 1')\n",
    "import os\nv_{id} = '" + "a" * 101 + "'\n",
    "def f_{id}(:\n    pass\n",
    "import os\nv_{id} = (1,\n",
    "import os\nfor a in [1]:\n    for b in [2]:\n        while b:\n            b = 0\n",
    "def h_{id}(n):\n    for a in n:\n        for b in n:\n            if b:\n                print(b)\n",
    'class K_{id}:\n    """Doc."""\n    def m1(self):\n        pass\n    async def m2(self):\n        pass\n',
    'import functools\n@functools.lru_cache(8)\n@deco\nasync def q_{id}(a, b):\n    """D."""\n    return a\n',
    "function f{id}(a) {\n  var x;\n  try { a(); } catch { return 0; }\n}\n",
    "public class C{id} {\n  void m() { try { run(); } }\n}\n",
    "require 'set'\nclass R{id} < Base\nend\n",
    "package main\n\nfunc F{id}() int { return 1 }\n",
    "fn f_{id}() -> i32 { 1 }\n",
    "# note {id}\ndef c_{id}():\n    return 1\n",
    "Plain words number {id} about nothing.\n",
    "import os\nif os.a:\n    pass\nelif os.b:\n    pass\nelif os.c_{id}:\n    pass\n",
    "    # only a comment {id}\n",
    "import pickle\nb_{id} = '" + "a" * 101 + "'\nc_{id} = eval('2')\n",
    "import os\ntry:\n    v_{id} = 1\nexcept:\n    try:\n        pass\n    finally:\n        pass\n",
    "import os\nv_{id} = " + "-" * 7000 + "1\n",
]
# What begins each line of the document's text after the template.
COMMENTS = ["# "] * 15 + ["// "] * 2 + ["# "] + ["// "] * 2 + ["# ", "", "# ", "    # "] + ["# "] * 3
EXTENSIONS = [".py", ".js", ".java", ".rb", ".go", ".rs", ".txt"]


def code_corpus(documents, *keep):
    """(doc_id, source, path, text) and ``keep``: one code file per document."""
    pick = F.element_at(
        F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("doc_id") % len(TEMPLATES) + 1).cast("int")
    )
    extension = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]),
        (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"),
    )
    prefix = F.element_at(
        F.array(*[F.lit(c) for c in COMMENTS]), (F.col("doc_id") % len(COMMENTS) + 1).cast("int")
    )
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(prefix, x)), "\n")
    key = F.col("doc_id").cast("string")
    return documents.select(
        "doc_id",
        "source",
        F.concat("source", F.lit("/file_"), key, extension).alias("path"),
        F.concat(F.replace(pick, F.lit("{id}"), key), body, F.lit("\n")).alias("text"),
        *keep,
    )
