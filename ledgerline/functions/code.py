"""Functions over source text that need a parser or the standard library's matcher:
Python functions for tests and small inputs, pandas and Arrow UDFs for DataFrames."""

from __future__ import annotations

import ast
import difflib
import hashlib
import io
import json
import keyword
import re
import tokenize
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

#: Nodes of a token stream, sizes of a function that is indexed, tokens and lines of a chunk
MOST_NODES, SHORTEST, LONGEST, CHUNK_TOKENS, CHUNK_LINES = 4_096, 40, 3_000, 384, 64

#: results that a worker keeps of each function, of texts of so many characters at most
KEPT, KEPT_CHARS = 4_096, 4_000

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.IfExp, ast.ExceptHandler, ast.comprehension, ast.BoolOp, ast.match_case)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_FSTRING = (getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "FSTRING_END", -1))


def parse(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@cache
def _kept(f):
    return lru_cache(KEPT)(f)


def once(f, *texts):
    """f(*texts), for functions of this module: texts that come again aren't parsed again by the same worker."""
    return _kept(f)(*texts) if sum(len(t) for t in texts if t) <= KEPT_CHARS else f(*texts)


def _children(node: ast.AST) -> list[ast.AST]:
    """ast.iter_child_nodes as a list."""
    out = []
    for name in node._fields:
        part = getattr(node, name, None)
        if isinstance(part, ast.AST):
            out.append(part)
        elif isinstance(part, list):
            out += [x for x in part if isinstance(x, ast.AST)]
    return out


def _nodes(node: ast.AST) -> list[ast.AST]:
    """ast.walk as a list."""
    out = [node]
    for n in out:  # grows on the way
        out += _children(n)
    return out


def compiles(source: str | None) -> bool:
    return parse(source) is not None


def branches(source: str | None) -> int:
    tree = parse(source)
    return sum(isinstance(n, _BRANCHES) for n in ast.walk(tree)) if tree else 0


def depth(source: str | None) -> int:
    tree = parse(source)
    deepest, stack = 0, [(tree, 1)] if tree else []
    while stack:
        node, d = stack.pop()
        deepest = max(deepest, d)
        stack += [(c, d + 1) for c in ast.iter_child_nodes(node)]
    return deepest


def calls(source: str | None) -> dict[str, set[str]]:
    """Function -> names that it calls; calls outside of any are under ''."""
    out: dict[str, set[str]] = {}
    stack = [(parse(source), "")]
    while stack:
        node, inside = stack.pop()
        if node is None:
            continue
        if isinstance(node, _FUNCTIONS):
            inside = node.name
            out.setdefault(inside, set())
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.setdefault(inside, set()).add(name)
        stack += [(c, inside) for c in ast.iter_child_nodes(node)]
    return out


def metrics(source: str | None) -> dict:
    """All that one parse tells: branches, depth, and of the functions' call
    graph the greatest in and out degree (calls of known functions count as in),
    edges, and the share without a call (of two functions or more); whether it
    compiles, imports, and the functions that are indexed. Zeros and imports by
    pattern for what doesn't parse."""
    tree = parse(source)
    out = {"branches": 0, "depth": 0, "max_in": 0, "max_out": 0, "edges": 0, "alone": 0.0, "compiles": tree is not None, "imports": imports_of(source, tree), "functions": []}
    if tree is None:
        return out
    graph: dict[str, set[str]] = {}
    defined = []
    stack: list[tuple[ast.AST, str, int]] = [(tree, "", 1)]
    while stack:
        node, inside, d = stack.pop()
        out["depth"] = max(out["depth"], d)
        out["branches"] += isinstance(node, _BRANCHES)
        if isinstance(node, _FUNCTIONS):
            inside = node.name
            graph.setdefault(inside, set())
            defined.append(node)
        elif isinstance(node, ast.Call) and inside:
            name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
            if name:
                graph[inside].add(name)
        stack += [(c, inside, d + 1) for c in _children(node)]
    into = dict.fromkeys(graph, 0)
    for called in graph.values():
        for name in called & into.keys():
            into[name] += 1
    out |= {"max_in": max(into.values(), default=0), "max_out": max(map(len, graph.values()), default=0), "edges": sum(map(len, graph.values()))}
    out["alone"] = sum(not called for called in graph.values()) / len(graph) if len(graph) > 1 else 0.0
    out["functions"] = [name for name, _, _ in _indexed(source, defined)]
    return out


def node_stream(source: str | None) -> list[str]:
    """Node types in order, at most MOST_NODES."""
    tree, out = parse(source), []
    stack = [tree] if tree else []
    while stack and len(out) < MOST_NODES:
        node = stack.pop()
        out.append(type(node).__name__)
        stack += reversed(list(ast.iter_child_nodes(node)))
    return out


#: Operators that carry logic
OPERATORS = {
    "+", "-", "*", "/", "%", "<", ">", "<=", ">=", "==", "===", "!=", "!==", "&&", "||", "!", "**", "&", "|", "^", "~", "<<", ">>", "?",
}


def _identifiers(node: ast.AST | None) -> set[str]:
    """All names in an expression, attributes too."""
    found = ast.walk(node) if node is not None else ()
    return {n.id if isinstance(n, ast.Name) else n.attr for n in found if isinstance(n, (ast.Name, ast.Attribute))}


def _bound(nodes: list[ast.AST]) -> set[str]:
    """Names that are local in some nodes: whatever stands in parameter lists
    (defaults and annotations too), on the left of assignments, and as the
    variable of a loop. Those of comprehensions, `with`, `except` and lambdas aren't."""
    out: set[str] = set()
    for n in nodes:
        if isinstance(n, _FUNCTIONS):
            a = n.args
            for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]:
                out |= {arg.arg} | _identifiers(arg.annotation)
            for default in [*a.defaults, *filter(None, a.kw_defaults)]:
                out |= _identifiers(default)
        elif isinstance(n, ast.Assign):
            out = out.union(*map(_identifiers, n.targets))
        elif isinstance(n, (ast.AugAssign, ast.AnnAssign, ast.For, ast.AsyncFor)):
            out |= _identifiers(n.target)
    return out


def _first_function(tree: ast.Module) -> ast.AST:
    """The first definition of a function, else the whole."""
    found = [n for n in _nodes(tree) if isinstance(n, _FUNCTIONS)]
    return min(found, key=lambda n: (n.lineno, n.col_offset)) if found else tree


def logic_tokens(source: str | None) -> list[str]:
    """What of the first function carries logic, in order: names that aren't
    local (N:<name>) and operators (K:<sign>). Its own name, local names, keywords,
    numbers, brackets, strings, annotations and decorators are left out. Without
    a function it is the whole source; where there is no parse, its words and signs."""
    tree = parse(source)
    if tree is None:
        words = re.findall(r"[^\W\d]\w*|\*\*|<<|>>|[<>=!]=|[^\w\s]", source or "")
        return [f"K:{w}" if w in OPERATORS else f"N:{w}" for w in words if w in OPERATORS or (w[0].isalpha() or w[0] == "_") and not keyword.iskeyword(w)]
    node = _first_function(tree)
    nodes = _nodes(node)
    local = _bound(nodes)
    spans = [n for x in nodes for n in (getattr(x, "annotation", None), getattr(x, "returns", None)) if n is not None]
    pruned = [((n.lineno, n.col_offset), (n.end_lineno, n.end_col_offset)) for n in spans]
    whole = node is tree
    first, last = (0, 0) if whole else (node.lineno, node.col_offset), (1 << 60, 0) if whole else (node.end_lineno, node.end_col_offset)
    lines, out, quoted, named = (source or "").splitlines(), [], 0, whole
    try:
        for t in tokenize.generate_tokens(io.StringIO(source or "").readline):
            line = lines[t.start[0] - 1] if t.start[0] <= len(lines) else ""
            at = (t.start[0], len(line[: t.start[1]].encode()))  # trees count bytes
            quoted += (t.type == _FSTRING[0]) - (t.type == _FSTRING[1])
            if quoted or not first <= at < last or any(a <= at < b for a, b in pruned):
                continue
            if t.type == tokenize.OP and t.string in OPERATORS:
                out.append(f"K:{t.string}")
            elif t.type == tokenize.NAME and not keyword.iskeyword(t.string):
                if named and t.string not in local:
                    out.append(f"N:{t.string}")
                named = True  # the first name is the function's own
    except (tokenize.TokenError, IndentationError):
        pass
    return out


def sequence_ratio(a: list[str], b: list[str]) -> float:
    """The standard library's ratio (which isn't symmetric); two empty sequences are equal."""
    return 1.0 if not len(a) and not len(b) else difflib.SequenceMatcher(None, list(a), list(b)).ratio()


def _dumped(source: str | None) -> list[str]:
    """The lines of the dumped tree; none where there is no parse."""
    tree = parse(source)
    return [] if tree is None else ast.dump(tree, indent=2, annotate_fields=False).splitlines()


def tree_distance(before: str | None, after: str | None) -> int:
    """Lines of the dumped trees that go and that come, a replaced one counting
    as both. A side without a parse has no lines; where neither has one it is the
    sources' lines, as sets, that differ."""
    x, y = _dumped(before), _dumped(after)
    if not x and not y:
        return len(set((before or "").splitlines()) ^ set((after or "").splitlines()))
    kept = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    return len(x) + len(y) - 2 * kept


def _indexed(source: str | None, found: list) -> list[tuple[str, int, str]]:
    """Definitions of SHORTEST to LONGEST characters, in order; places in a tree are in bytes."""
    lines = (source or "").encode().splitlines(keepends=True) if found else []
    out = []
    for n in sorted(found, key=lambda n: (n.lineno, n.col_offset)):
        part = lines[n.lineno - 1 : n.end_lineno]
        part[-1] = part[-1][: n.end_col_offset]
        part[0] = part[0][n.col_offset :]
        text = b"".join(part).decode()
        if SHORTEST <= len(text) <= LONGEST:
            out.append((n.name, n.lineno, text))
    return out


def functions_of(source: str | None) -> list[tuple[str, int, str]]:
    """(name, line, source) of named functions of SHORTEST to LONGEST characters, in order."""
    tree = parse(source)
    return _indexed(source, [] if tree is None else [n for n in ast.walk(tree) if isinstance(n, _FUNCTIONS)])


def imports_of(source: str | None, tree: ast.Module | None = None) -> list[str]:
    """Modules that Python or script source imports, sorted; by pattern where there is no parse."""
    tree = tree or parse(source)
    if tree is not None:
        out = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
        out |= {"." * n.level + (n.module or "") for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
        return sorted(out)
    script = re.findall(r"""(?:\bfrom|\bimport|\brequire\s*\()\s*\(?\s*["']([^"']+)["']""", source or "")
    python = re.findall(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)", source or "")
    return sorted({*script, *python})


def chunks(source: str | None) -> list[tuple[int, int, str]]:
    """(first byte, end byte, kind) over the whole text: top-level definitions
    that fit the token budget (4 bytes each), the rest in windows of lines."""
    text = source or ""
    lines = text.splitlines(keepends=True)
    tree = parse(text)
    cuts = []
    for node in tree.body if tree else []:
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            if sum(len(x.encode()) for x in lines[first : node.end_lineno]) <= 4 * CHUNK_TOKENS:
                cuts.append((first, node.end_lineno))
    spans, at = [], 0
    for first, end in [*cuts, (len(lines), len(lines))]:
        spans += [(k, min(k + CHUNK_LINES, first), "lines") for k in range(at, first, CHUNK_LINES)]
        if end > first:
            spans.append((first, end, "scope"))
        at = max(at, end)
    starts = np.cumsum([0, *(len(x.encode()) for x in lines)]).tolist()
    return [(starts[a], starts[b], kind) for a, b, kind in spans]


def changed_lines(before: str | None, after: str | None, autojunk: bool = True) -> list[int]:
    """Numbers, from 1, of the lines of `after` that are new or changed."""
    x, y = (before or "").splitlines(), (after or "").splitlines()
    codes = difflib.SequenceMatcher(None, x, y, autojunk=autojunk).get_opcodes()
    return [j + 1 for tag, _, _, j1, j2 in codes if tag in ("insert", "replace") for j in range(j1, j2)]


def changed_bytes(before: str | None, after: str | None) -> list[tuple[int, int]]:
    """Byte ranges of `after` that are new or changed."""
    x, y = (before or "").splitlines(keepends=True), (after or "").splitlines(keepends=True)
    starts = np.cumsum([0, *(len(t.encode()) for t in y)]).tolist()
    codes = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [(starts[j1], starts[j2]) for tag, _, _, j1, j2 in codes if tag != "equal" and j2 > j1]


def chunk_weights(changed: list[bool]) -> list[float]:
    """A changed chunk weighs 1, its neighbours 0.25, others nothing; scaled to sum 1 (equal if none changed)."""
    raw = [1.0 if c else 0.25 if any(changed[max(0, i - 1) : i + 2]) else 0.0 for i, c in enumerate(changed)]
    total = sum(raw)
    return [x / total for x in raw] if total else [1 / len(changed)] * len(changed)


def pooled(vectors: list[list[float]], weights: list[float]) -> list[float]:
    v = np.average(np.array(vectors, dtype=np.float64), axis=0, weights=weights)
    size = np.linalg.norm(v)
    return (v / size if size else v).tolist()


def apply_edit(kind: str, before: str | None, payload: dict) -> str | None:
    """The text after an edit: whole writes, one replacement, or several in turn; null where the old text is missing."""
    if kind == "write":
        return payload.get("content", "")
    text = before or ""
    for e in payload.get("edits", [payload]) if kind == "multi" else [payload]:
        old, new = e.get("old", ""), e.get("new", "")
        if old and old not in text:
            return None
        text = new + text if not old else text.replace(old, new) if e.get("all") else text.replace(old, new, 1)
    return text


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


_FILE_LINE = ("diff --git ", "--- ", "+++ ")


def _patch_lines(diff: str | None) -> list[str]:
    text = diff or ""
    return text.removesuffix("\n").split("\n") if text else []


def _hunks(lines: list[str]) -> list[tuple[int, re.Match | None, list[int]]]:
    """(place of the header, what it says, places of the body's lines); a header that says nothing has no body."""
    out: list[tuple[int, re.Match | None, list[int]]] = []
    inside = False
    for i, line in enumerate(lines):
        if line.startswith("@@"):
            head = _HUNK.match(line)
            inside = head is not None
            out.append((i, head, []))
        elif line.startswith(_FILE_LINE):
            inside = False
        elif inside:
            out[-1][2].append(i)
    return out


def diff_errors(diff: str | None) -> list[tuple[int, str]]:
    """(line, kind) of what is wrong with a unified diff, in order: empty_input,
    bad_hunk_header, empty_context (a bare empty line; it counts as context),
    missing_prefix, count_mismatch (at the hunk's header) and missing_hunk."""
    if not diff:
        return [(0, "empty_input")]
    lines, out = _patch_lines(diff), []
    hunks = _hunks(lines)
    for place, head, body in hunks:
        if head is None:
            out.append((place + 1, "bad_hunk_header"))
            continue
        out += [(i + 1, "missing_prefix" if lines[i] else "empty_context") for i in body if lines[i][:1] not in (" ", "+", "-", "\\")]
        signs = [lines[i][:1] or " " for i in body]
        counted = tuple(sum(c in side for c in signs) for side in (" -", " +"))
        if counted != (int(head[2] or 1), int(head[4] or 1)):
            out.append((place + 1, "count_mismatch"))
    return out if any(head for _, head, _ in hunks) else [*out, (0, "missing_hunk")]


def repair_diff(diff: str | None) -> str | None:
    """The diff with counts as the bodies have them, bare empty lines as empty
    context, and lines without a sign joined to the one before. Null where that
    is out of reach: no text, a header that can't be read, a side of a hunk without lines."""
    if not diff:
        return None
    out: list[str] = []
    body: list[str] | None = None
    head = 0
    for line in [*_patch_lines(diff), None]:
        if line is None or line.startswith(("@@", *_FILE_LINE)):
            if body:
                m = _HUNK.match(out[head])
                old, new = (sum(x[:1] in side for x in body) for side in ((" ", "-"), (" ", "+")))
                if m is None or not old or not new:
                    return None
                out[head] = f"@@ -{int(m[1])},{old} +{int(m[3])},{new} @@"
                out += body
            if line is not None:
                body = [] if line.startswith("@@") else None
                head = len(out)
                out.append(line)
        elif body is None:
            out.append(line)
        elif line[:1] in ("", " ", "+", "-", "\\"):
            body.append(line or " ")
        elif body:
            body[-1] += line
    return "\n".join(out) + "\n" * diff.endswith("\n")


def control_embedding(tokens: list[str], dim: int = 64) -> list[float]:
    """Mean of Gaussian vectors that the tokens' digests seed: a baseline that knows no meaning, the same everywhere."""
    if not len(tokens):
        return [0.0] * dim
    draws = [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")).standard_normal(dim) for t in tokens]
    return np.mean(draws, axis=0).tolist()


def stable_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def close_matches(name: str, known: list[str], n: int = 3, cutoff: float = 0.6) -> list[str]:
    return difflib.get_close_matches(name, known, n, cutoff)


def _column(kind: T.DataType, f, keep: bool = False):
    """A pandas UDF of a function of one column or more; keep: of texts, by `once`."""

    @pandas_udf(kind)
    def each(*columns: pd.Series) -> pd.Series:
        return pd.Series([once(f, *row) if keep else f(*row) for row in zip(*columns, strict=True)])

    return each


_STRINGS, _INTS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
_METRICS = {**dict.fromkeys(("branches", "depth", "max_in", "max_out", "edges"), T.IntegerType()), "alone": T.DoubleType(), "compiles": T.BooleanType(), "imports": _STRINGS, "functions": _STRINGS}


@pandas_udf(T.StructType([T.StructField(k, t) for k, t in _METRICS.items()]))
def metrics_udf(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame.from_records([tuple(once(metrics, s).values()) for s in source], columns=list(_METRICS))


_ARROW = {T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), _STRINGS: pa.list_(pa.string())}
_TOLD = pa.struct([(k, _ARROW[t]) for k, t in _METRICS.items()])


@arrow_udf(T.StructType([T.StructField(k, t) for k, t in _METRICS.items()]))
def metrics_arrow_udf(source: pa.Array) -> pa.Array:
    """As metrics_udf; a batch's different texts alone become Python's strings and results, which its rows take by their places."""
    each = source.dictionary_encode(null_encoding="encode")
    return pa.array([once(metrics, s) for s in each.dictionary.to_pylist()], _TOLD).take(each.indices)


def risk_deltas(before, after, churn, novelty):
    """The eight differences that an edit makes, for gates.risk_vector: of metrics_arrow_udf's
    structs before and after, the churn in lines, and the novelty."""
    more = [F.greatest(F.lit(0.0), (after[k] - before[k]).cast("double")) for k in ("branches", "max_in", "max_out", "depth", "edges", "alone")]
    return F.array(*more[:4], churn.cast("double"), *more[4:], novelty.cast("double"))


branches_udf = _column(T.IntegerType(), branches)
depth_udf = _column(T.IntegerType(), depth)
compiles_udf = _column(T.BooleanType(), compiles)
imports_udf = _column(_STRINGS, imports_of)
logic_tokens_udf = _column(_STRINGS, logic_tokens, keep=True)
node_stream_udf = _column(_STRINGS, node_stream)
sequence_ratio_udf = _column(T.DoubleType(), sequence_ratio)
tree_distance_udf = _column(T.IntegerType(), tree_distance)
changed_lines_udf = _column(_INTS, changed_lines)
changed_bytes_udf = _column(T.ArrayType(_INTS), lambda before, after: [list(r) for r in changed_bytes(before, after)])
chunks_udf = _column(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])), chunks, keep=True)
chunk_weights_udf = _column(T.ArrayType(T.DoubleType()), lambda changed: None if changed is None else chunk_weights([bool(c) for c in changed]))
apply_edit_udf = _column(T.StringType(), lambda kind, before, payload: apply_edit(kind, before, json.loads(payload)))
stable_hash_udf = _column(T.StringType(), lambda text: None if text is None else stable_hash(json.loads(text)))


@pandas_udf(T.StructType([T.StructField("errors", T.StringType()), T.StructField("repaired", T.StringType())]))
def diff_findings_udf(diff: pd.Series) -> pd.DataFrame:
    """The errors, and where there are some in a text the first hunk header of its repair, `none` if it is out of reach."""
    out = []
    for text in diff:
        text = text if isinstance(text, str) else None
        errors = diff_errors(text)
        fixed = repair_diff(text) if text and errors else ""
        head = next((x for x in (fixed or "").split("\n") if x.startswith("@@")), None)
        out.append((",".join(f"{line} {kind}" for line, kind in errors), "none" if fixed is None else head))
    return pd.DataFrame(out, columns=["errors", "repaired"])


@F.udtf(returnType="name string, line int, source string")
class FunctionsOf:
    def eval(self, source: str):
        yield from functions_of(source)


@F.udtf(returnType="first int, end int, kind string")
class ChunksOf:
    def eval(self, source: str):
        yield from chunks(source)


def register(spark) -> None:
    """The same under SQL names."""
    for name, f in {
        "code_branches": branches_udf, "code_depth": depth_udf, "code_compiles": compiles_udf, "code_imports": imports_udf, "code_logic_tokens": logic_tokens_udf,
        "code_ratio": sequence_ratio_udf, "code_tree_distance": tree_distance_udf, "code_changed_lines": changed_lines_udf,
    }.items():
        spark.udf.register(name, f)
    spark.udtf.register("code_functions", FunctionsOf)
    spark.udtf.register("code_chunks", ChunksOf)
