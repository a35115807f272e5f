"""Operations that answer a user's question about a code base in one go, and the small parts that they share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize
from graphloom.sources.resolve import above, folder

# -- languages of headers

#: (Fixed values.) What only Objective-C and only C++ write in a header.
OBJC_MARKS = (
    r"(?m)^\s*(?:#\s*import\b|@(?:interface|implementation|protocol|end|class|property|optional|required|import|synthesize|dynamic)\b)"
)
CPP_MARKS = (
    r"(?m)^\s*(?:namespace\s+\w*\s*\{|template\s*<|class\s+\w+[^;{]*[;{:]|(?:public|private|protected)\s*:|virtual\s+\w"
    r"|extern\s+\"C\+\+\"|using\s+namespace\s)"
)


def header_languages(files: DataFrame) -> DataFrame:
    """(repo, path, language): headers tagged c that belong to Objective-C, else to C++, are tagged so.

    A header beside a file of that language belongs to it. Elsewhere in a repository with sources of the language, a header
    belongs to it if no .c file is beside it and its own text has a mark of the language. files: (repo, path, language, text).
    """
    own = files.select("repo", "path", folder(F.col("path")).alias("dir"), "language", "text")
    for language, sources, marks in (("objective-c", r"\.mm?$", OBJC_MARKS), ("cpp", r"\.(?:cpp|cc|cxx|c\+\+)$", CPP_MARKS)):
        tagged = own.where(F.col("language") == language)
        beside = tagged.select("repo", "dir").distinct().withColumn("beside", F.lit(True))
        somewhere = tagged.where(F.col("path").rlike(sources)).select("repo").distinct().withColumn("somewhere", F.lit(True))
        plain = own.where("language = 'c' AND path LIKE '%.c'").select("repo", "dir").distinct().withColumn("plain", F.lit(True))
        met = own.join(beside, ["repo", "dir"], "left").join(somewhere, "repo", "left").join(plain, ["repo", "dir"], "left")
        header = (F.col("language") == "c") & F.endswith("path", F.lit(".h")) & F.col("somewhere").isNotNull()
        belongs = F.col("beside").isNotNull() | (F.col("plain").isNull() & F.coalesce(F.col("text").rlike(marks), F.lit(False)))
        own = met.select("repo", "path", "dir", F.when(header & belongs, language).otherwise(F.col("language")).alias("language"), "text")
    return own.select("repo", "path", "language")


def test_owned(files: DataFrame, roles: DataFrame) -> DataFrame:
    """Files (path) of test trees: a folder above is a test module, or all modules at and under the file's folder are.

    roles: (module, role), a module being a folder.
    """
    tests = roles.where("role = 'test'").select(F.col("module").alias("dir"))
    ups = files.select("path", F.explode(above("path")).alias("dir")).where("dir <> ''")
    inside = ups.join(tests, "dir", "left_semi").select("path")
    under = roles.select("role", F.explode(F.concat(above("module"), F.array("module"))).alias("dir")).where("dir <> ''")
    whole = under.groupBy("dir").agg(F.bool_and(F.col("role") == "test").alias("all")).where("all").select("dir")
    roots = files.select("path", folder(F.col("path")).alias("dir")).join(whole, "dir", "left_semi").select("path")
    return inside.unionAll(roots).distinct()


# -- identifiers


def chunk_parts(chunk_id: Column) -> Column:
    """struct<path, kind, symbol, b, e> of a chunk's id; lines are 0 where the id has none."""
    shape = r"^([^#]*)#([^:]*):(.*):L(\d+)-L(\d+)(?::b\d+-\d+)?$"
    part = lambda n: F.regexp_extract(chunk_id, shape, n)
    rest = F.regexp_replace(chunk_id, "^[^#]*#", "")
    known = F.struct(part(1).alias("path"), part(2).alias("kind"), part(3).alias("symbol"), part(4).cast("int").alias("b"), part(5).cast("int").alias("e"))
    other = F.struct(
        F.substring_index(chunk_id, "#", 1).alias("path"), F.lit("chunk").alias("kind"), rest.alias("symbol"), F.lit(0).alias("b"), F.lit(0).alias("e")
    )
    return F.when(chunk_id.rlike(shape), known).when(F.contains(chunk_id, F.lit("#")), other)


def parse_error_count(errors: Column) -> Column:
    """N of the first entry `parse_error_nodes:N` of a list of errors; 0 without one."""
    shape = r"^parse_error_nodes:(\d+)$"
    first = F.get(F.filter(errors, lambda e: e.rlike(shape)), F.lit(0))
    return F.coalesce(F.regexp_extract(first, shape, 1).cast("int"), F.lit(0))


def _cut(name: str, parts: list[str]) -> list[str] | None:
    """The words of a name cut into all of these parts and no others; of several cuts the one with the longest first parts.

    From the last word to the first, each place keeps for every set of parts its best cut of the rest of the name.
    """
    starts = [0, *(i + 1 for i, c in enumerate(name) if c == "_")]
    ways: list[dict[int, tuple[int, ...]]] = [{} for _ in starts] + [{0: ()}]
    for i in reversed(range(len(starts))):
        for n, part in enumerate(parts):
            end, size = starts[i] + len(part), part.count("_") + 1
            if name.startswith(part, starts[i]) and name[end : end + 1] in ("", "_"):
                for used, rest in ways[i + size].items():
                    ways[i][used | 1 << n] = max(ways[i].get(used | 1 << n, ()), (size, *rest))
    best, out, at = ways[0].get((1 << len(parts)) - 1), [], 0
    for size in best or ():
        end = starts[at + size] - 1 if at + size < len(starts) else len(name)
        out.append(name[starts[at] : end])
        at += size
    return out if best else None


def compound_parts(compounds: DataFrame) -> DataFrame:
    """(id, parts in order) of compounds (id, parts): the id, with or without its ending, cut into exactly these parts.

    Without such a cut the parts are sorted. Null ids and null parts have none.
    """

    def ordered(name: str | None, parts: list[str] | None) -> list[str]:
        wanted = sorted({p for p in (parts if parts is not None else []) if p is not None})
        if not wanted or name is None:
            return wanted
        return _cut(name, wanted) or _cut(name.removesuffix("_compound"), wanted) or wanted

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "parts": [ordered(n, p) for n, p in zip(f["id"], f["parts"])]})

    return compounds.select("id", "parts").mapInPandas(run, "id string, parts array<string>")


#: (Fixed values.) What a term of a vocabulary may be.
TERM_KINDS = ["domain-primitive", "structural-primitive", "relational-primitive"]


def vocabulary(text: str) -> list[tuple[str, str, str | None, str]]:
    """(term, kind, broader, alias) of a vocabulary in YAML, each term being its own first alias.

    ValueError for another version, unknown kinds, terms that occur twice, and aliases of unknown or of two terms.
    """
    import yaml

    doc = yaml.safe_load(text) or {}
    if not isinstance(doc, dict) or doc.get("version", 1) != 1:
        raise ValueError("not a vocabulary of version 1")
    kinds, broader = doc.get("kinds") or {}, doc.get("broader") or {}
    if unknown := (set(kinds) | set(broader)) - set(TERM_KINDS):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")

    def plain(name: object) -> str:
        return str(name).strip().lower()

    kind_of: dict[str, str] = {}
    for kind, names in kinds.items():
        for name in map(plain, names or []):
            if name in kind_of:
                raise ValueError(f"{name} occurs twice")
            kind_of[name] = kind
    owner = {name: name for name in kind_of}
    for term, names in (doc.get("aliases") or {}).items():
        for alias in map(plain, names or []):
            if plain(term) not in kind_of or owner.setdefault(alias, plain(term)) != plain(term):
                raise ValueError(f"alias {alias} of {term}")
    return [(term, kind_of[term], broader.get(kind_of[term]), alias) for alias, term in owner.items()]


# -- selections


def two_tiers(concepts: DataFrame, n: int) -> DataFrame:
    """(name, tier): all concepts with a kind, and the n most frequent others, those of more files and earlier names first."""
    rest = concepts.where("kind IS NULL").orderBy(F.desc("frequency"), F.desc("file_count"), "name").limit(n)
    named = concepts.where("kind IS NOT NULL").select("name", F.lit("vocab").alias("tier"))
    return named.unionAll(rest.select("name", F.lit("corpus_top").alias("tier")))


#: Kinds of entries in the order in which equal hits are shown.
ENTRY_KINDS = ["page", "doc", "package", "file", "concept"]


def site_search(index: DataFrame, text: str, n: int = 100) -> DataFrame:
    """Entries (title, url, kind, hint) in which a text occurs: titles that begin with it, that hold it, then hints; with the
    score, the place in the list and the number of all hits."""
    from pyspark.sql import Window

    q = text.strip().lower()
    at = F.locate(q, F.lower("title"))
    hits = index.where((at > 0) | F.contains(F.lower(F.coalesce("hint", F.lit(""))), F.lit(q)))
    rank = F.array_position(F.array(*map(F.lit, ENTRY_KINDS)), F.col("kind")) - 1
    score = F.when(at == 1, 0).when(at > 1, 1).otherwise(2) * 10 + F.when(rank >= 0, rank).otherwise(9)
    scored = hits.select("*", score.cast("int").alias("score"))
    total = scored.agg(F.count("*").alias("total"))
    top = scored.orderBy("score", F.length("title"), "title", "url").limit(n)
    order = Window.orderBy("score", F.length("title"), "title", "url")  # over n rows at most
    return top.withColumn("place", F.row_number().over(order)).join(F.broadcast(total), F.lit(True))


def filter_rows(rows: DataFrame, text: str, order: str, descending: bool, n: int) -> DataFrame:
    """Rows of which any column holds a text, sorted by a column that the user chose (all others break ties)."""
    cells = F.array(*(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns))
    kept = rows.where(F.exists(cells, lambda c: F.contains(c, F.lit(text.lower()))))
    first = F.desc(order) if descending else F.asc(order)
    return kept.orderBy(first, *(c for c in rows.columns if c != order)).limit(n)


def inheritance_depth(edges: DataFrame, guard: int = 12) -> DataFrame:
    """(node, depth): the longest way down from a class without a base, at most `guard`; edges are (child, base).

    Classes that are reached from no such class (rings) are left out.
    """
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("base")).distinct()
    level = materialize(nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti"))
    levels = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, guard + 1):
        level = materialize(edges.join(level.withColumnRenamed("node", "base"), "base").select(F.col("child").alias("node")).distinct())
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out.groupBy("node").agg(F.max("depth").alias("depth"))


def keystone(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, score): the file with the most (imports of it) x (symbols in it), of those with three symbols or more that are no
    package's __init__; of all files if there is none such."""
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("into"))
    own = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    met = files.select("path").join(into, "path", "left").join(own, "path", "left").fillna(0)
    real = (F.substring_index("path", "/", -1) != "__init__.py") & (F.col("symbols") >= 3)
    scored = met.select("path", (F.col("into") * F.col("symbols")).alias("score"), real.alias("real"))
    return scored.orderBy(F.desc("real"), F.desc("score"), "path").limit(1).select("path", "score")


def interchanges(edges: DataFrame, subsystems: DataFrame, core: str) -> DataFrame:
    """(path, n): files of the core that two or more other subsystems import. subsystems: (path, subsystem)."""
    s = subsystems.select(F.col("path").alias("src"), F.col("subsystem").alias("from"))
    d = subsystems.where(F.col("subsystem") == core).select(F.col("path").alias("dst"))
    met = edges.join(d, "dst").join(s, "src").where(F.col("from") != core)
    return met.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("from").alias("n")).where("n >= 2")


def unique_bases(derived: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, child, target): bases by name (path, child, base) that exactly one class (path, name) bears."""
    alone = classes.groupBy("name").agg(F.min("path").alias("target"), F.count("*").alias("n")).where("n = 1")
    return derived.join(alone, derived.base == alone.name).select("path", "child", "target")


# -- details


def file_details(files: DataFrame, edges: DataFrame, external: DataFrame, chunks: DataFrame, xrefs: DataFrame) -> DataFrame:
    """For each file (path): sorted arrays imports_out, imports_in, external_imports, chunks, xrefs_out and xrefs_in.

    edges: (src, dst); external: (path, package); chunks: (path, chunk); xrefs: (src, dst) of chunks, each peer once.
    """

    def listed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("path")).agg(F.array_sort(F.collect_set(value)).alias(name))

    by_src = chunks.select(F.col("path").alias("s"), F.col("chunk").alias("src"))
    by_dst = chunks.select(F.col("path").alias("d"), F.col("chunk").alias("dst"))
    parts = [
        listed(edges, "src", "dst", "imports_out"),
        listed(edges, "dst", "src", "imports_in"),
        listed(external, "path", "package", "external_imports"),
        listed(chunks, "path", "chunk", "chunks"),
        listed(xrefs.join(by_src, "src"), "s", "dst", "xrefs_out"),
        listed(xrefs.join(by_dst, "dst"), "d", "src", "xrefs_in"),
    ]
    out = files.select("path")
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "path", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def concept_details(mentions: DataFrame, pairs: DataFrame, n_files: int, n_near: int) -> DataFrame:
    """For each concept: its first files, the heaviest neighbours, and how many files there are.

    mentions: (concept, path); pairs: (a, b, weight), each pair once. Heavy concepts are cut to their first entries by ranks
    that are taken before anything is collected.
    """
    from pyspark.sql import Window

    m = mentions.distinct()
    total = m.groupBy("concept").agg(F.count("*").alias("file_count"))
    first = m.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy("path"))).where(F.col("r") <= n_files)
    files = first.groupBy("concept").agg(F.array_sort(F.collect_list("path")).alias("files"))
    both = pairs.select(F.col("a").alias("concept"), F.col("b").alias("name"), "weight").unionAll(pairs.select("b", "a", "weight"))
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("weight"), "name"))).where(F.col("r") <= n_near)
    listed = near.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("r", "name", "weight"))).alias("near"))
    named = listed.select("concept", F.transform("near", lambda x: x["name"]).alias("cooccurring"))
    return total.join(files, "concept").join(named, "concept", "left").withColumn("cooccurring", F.coalesce("cooccurring", F.array()))


# -- answers that are kept


def memo_key(kind: Column, model: Column, prompt: Column, target: Column) -> Column:
    """The key of an answer: the digest of what it was asked for."""
    return F.sha2(F.concat_ws("\x1f", kind, model, F.sha2(prompt, 256), F.sha2(target, 256)), 256)


def memoised(requests: DataFrame, memory: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new memory): requests with `key` are answered from the memory (key, value); `answer` sees each distinct key that
    isn't there once, and what it gives (key, value) is remembered."""
    missing = requests.join(memory.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = materialize(answer(missing).select("key", "value"))
    every = memory.select("key", "value").unionAll(fresh)
    return requests.join(every, "key", "left"), every
