"""Python source features: one Arrow pass per corpus, no shuffle, one output row per file.

The worker only turns a file into facts; every rule, count and report on top of them is a
column expression or a join (see ``analysis`` and ``corpus_jobs``).
"""

import ast
import warnings

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

FACT = (
    "struct<kind:string,name:string,line:int,col:int,ord:int,size:int,"
    "names:array<string>,extra:array<string>,docstring:string>"
)
RESULT = (
    "valid boolean, error_class string, error_message string, error_line int, error_col int, "
    f"depth int, depth_full int, facts array<{FACT}>"
)
NESTING = (ast.For, ast.While, ast.If)
TOO_DEEP = "..."
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20  # files a worker parses before it gives out their facts


def source_text(node):
    """Source of an expression; a placeholder for one nested too deeply to be written out."""
    try:
        return ast.unparse(node)
    except RecursionError:
        return TOO_DEEP


def dotted(node):
    """``a.b.c`` for names and attributes; source text for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else source_text(node))
    return ".".join(reversed(parts))


def nesting(tree):
    """Deepest chain of loops and conditions from the top level, and through any statement."""
    direct = full = 0
    todo = [(tree, 0, True)]
    while todo:
        node, depth, linked = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, NESTING):
                full = max(full, depth + 1)
                direct = max(direct, depth + 1 if linked else 0)
                todo.append((child, depth + 1, linked))
            else:
                todo.append((child, depth, False))
    return direct, full


def fact(node, order, kind, name=None, size=None, names=None, extra=None, docstring=None):
    return (kind, name, node.lineno, node.col_offset, order, size, names, extra, docstring)


def node_facts(node, order):
    """Facts of one syntax node other than its position."""
    if isinstance(node, ast.Import):
        for alias in node.names:
            yield fact(node, order, "import", alias.name, names=[alias.name])
    elif isinstance(node, ast.ImportFrom):
        members = [alias.name for alias in node.names]
        yield fact(node, order, "import", f"{node.module}.{', '.join(members)}", names=members)
    elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        yield fact(
            node, order, "function", node.name,
            names=[a.arg for a in node.args.args],
            extra=[dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list],
            docstring=ast.get_docstring(node),
        )
    elif isinstance(node, ast.ClassDef):
        yield fact(
            node, order, "class", node.name,
            names=[dotted(b) for b in node.bases],
            extra=[m.name for m in node.body if isinstance(m, ast.FunctionDef)],
            docstring=ast.get_docstring(node),
        )
    elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
        yield fact(node, order, "call", dotted(node.func))
    elif isinstance(node, ast.Assign):
        if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            yield fact(node, order, "string", size=len(node.value.value))
    elif isinstance(node, ast.Try):
        yield fact(node, order, "try", size=len(node.handlers))
    elif isinstance(node, ast.ExceptHandler):
        yield fact(node, order, "handler", size=int(node.type is not None or node.name is not None))


def parse(code):
    """One result row for one file; a file that can't be analysed has ``error_class`` and no facts."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
        return (True, None, None, None, None, *nesting(tree), facts_of(tree))
    except SyntaxError as error:
        return False, "SyntaxError", str(error), error.lineno, error.offset, None, None, []
    except (ValueError, RecursionError, MemoryError) as error:
        return False, type(error).__name__, str(error), None, None, None, None, []


def facts_of(tree):
    """All facts of a syntax tree, breadth first."""
    facts, leftmost = [], {}
    for order, node in enumerate(ast.walk(tree)):
        if hasattr(node, "lineno") and node.col_offset < leftmost.get(node.lineno, 1 << 30):
            # Breadth first, only a node further left than all before it can be found later.
            leftmost[node.lineno] = node.col_offset
            facts.append(fact(node, order, "node", type(node).__name__))
        facts.extend(node_facts(node, order))
    return facts


def slices(batch, code):
    """Consecutive parts of an Arrow batch of SLICE_ROWS rows and about SLICE_BYTES of ``code`` at most."""
    sizes = pc.binary_length(batch.column(code)).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def python_features(df, code="text", keep=("doc_id",)):
    """One row per file with ``keep`` columns, validity, nesting depth and the fact array.

    Filter and project before calling: nothing is pushed below the Python stage. A worker holds the
    facts of a slice of files at once, whatever the size of the Arrow batches; ``keep`` stays in Arrow.
    """
    keep = list(keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    fields = list(to_arrow_schema(T.StructType.fromDDL(RESULT)))

    def run(batches):
        for batch in batches:
            for part in slices(batch, code):
                parsed = zip(*[parse(c) for c in part.column(code).to_pylist()])
                made = [pa.array(list(values), f.type) for values, f in zip(parsed, fields)]
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), *made], [*keep, *[f.name for f in fields]])

    columns = keep if code in keep else [*keep, code]
    return df.select(*columns).where(F.col(code).isNotNull()).mapInArrow(run, f"{kept}, {RESULT}")


def feature_table(features, keep=("doc_id",)):
    """Long form: one row per fact."""
    return features.select(*keep, F.inline("facts"))


def of_kind(kind, facts="facts"):
    """The facts of one kind as an array."""
    return F.filter(facts, lambda f: f["kind"] == kind)


@udtf(returnType="module string, line int", useArrow=True)
class PyImports:
    """SQL table function ``py_imports(code)``: one row per import entry."""

    def eval(self, code: str):
        for kind, name, line, *_ in parse(code or "")[-1]:
            if kind == "import":
                yield name, line


def register_functions(spark):
    spark.udtf.register("py_imports", PyImports)
