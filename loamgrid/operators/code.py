"""Code structure over tables of source lines (path, line, text): symbols, usages, coupling, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators.index import small

PATTERNS = [
    ("unsafe", ["unsafe "]),
    ("ffi", ["dlsym", "dlopen", "@objc", "@_silgen_name", "#[no_mangle]", 'extern "C"']),
    ("mmap", ["mmap ", "mmap(", "UnsafeMutablePointer", "UnsafeRawPointer", "from_raw_parts"]),
    ("lock", ["flock(", "NSLock", "DispatchQueue", "os_unfair_lock", "AtomicU", "RwLock", "Mutex"]),
    ("perf", ["MTLComputeCommandEncoder", "commandBuffer", "dispatchThreadgroups", "threadgroup", "simdgroup", "simd_sum"]),
]
_IDENT = r"([A-Za-z][\p{L}\p{N}_]+)"
_RULES = {
    "rs": (r"^(?:pub |pub\(crate\) |pub\(super\) |async |unsafe |const |static )*", [("fn", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait")]),
    "swift": (r"^(?:public |private |internal |open |final |override |static |class (?=func |var )|@objc )*", [("func", "fn"), ("class", "class"), ("struct", "struct"), ("protocol", "protocol"), ("enum", "enum")]),
}


def is_comment(text: Column) -> Column:
    return text.rlike(r"^(//|/\*|\* )")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def symbols(lines: DataFrame) -> DataFrame:
    """(name, kind, path, line, signature) by the rules of each file's language."""
    t = X.trim("text")
    ext = extension(F.col("path"))
    found = []
    for lang, (lead, words) in _RULES.items():
        for word, kind in words:
            ident = r"([\p{Lu}][\p{L}\p{N}_]+)" if word == "class" else _IDENT
            name = F.regexp_extract(t, lead + word + " " + ident, 1)
            found.append(F.when((ext == lang) & (name != ""), F.struct(name.alias("name"), F.lit(kind).alias("kind"))))
    c = ext.isin("metal", "h", "c", "m")
    kernel = F.regexp_extract(t, "^kernel void " + _IDENT, 1)
    typed = F.regexp_extract(t, r"^(?:void|float|int|inline|static) (?:[^ ]* )?([A-Za-z0-9_]{2,})\(", 1)
    found.append(F.when(c & (kernel != ""), F.struct(kernel.alias("name"), F.lit("kernel").alias("kind"))))
    found.append(F.when(c & (kernel == "") & (typed != ""), F.struct(typed.alias("name"), F.lit("fn").alias("kind"))))
    # exploded, so that the rules are compiled and run once and not for each of their fields
    s = lines.filter(~is_comment(t) & (t != "")).withColumn("s", F.explode(F.array(F.coalesce(*found)))).filter("s is not null")
    return s.select("s.name", "s.kind", "path", "line", X.truncate_bytes(t, 120).alias("signature"))


def identifiers(lines: DataFrame) -> DataFrame:
    """(path, line, name) once per line, comment lines left out; all joins of names to uses go over these."""
    code = lines.filter(~is_comment(X.trim("text")))
    return code.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))).alias("name"))


def usages(lines: DataFrame, syms: DataFrame) -> DataFrame:
    """(name, def_path, def_line, path, line): lines with a symbol's name, but for its definition.

    Definitions are broadcast where a count says so: then a name that many lines have is no hot key.
    """
    d = syms.select("name", F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    return identifiers(lines).join(small(d), "name").filter((F.col("path") != F.col("def_path")) | (F.col("line") != F.col("def_line")))


def coupling(lines: DataFrame, syms: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n): symbols of four bytes or more that either file of a pair has of the other."""
    d = syms.filter(F.octet_length("name") >= 4).select("name", F.col("path").alias("home"), "line")
    words = lines.select("path", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1))).alias("name")).distinct()
    p = words.join(d, "name").filter("path <> home")
    return p.groupBy(F.least("path", "home").alias("a"), F.greatest("path", "home").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def blast_radius(lines: DataFrame, syms: DataFrame, path: str) -> DataFrame:
    """(name, uses, files) for the symbols of one file; unused ones have 0."""
    own = syms.filter(F.col("path") == path)
    u = usages(lines, own).groupBy("name", "def_line").agg(F.count("*").alias("uses"), F.array_sort(F.collect_set("path")).alias("files"))
    return own.select("name", F.col("line").alias("def_line")).join(u, ["name", "def_line"], "left").select("name", "def_line", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def trace(lines: DataFrame, syms: DataFrame, name: str) -> DataFrame:
    """(role, path, line): definitions and usages of a symbol; a symbol with definitions alone is dead code."""
    d = syms.filter(F.col("name") == name)
    first = d.orderBy("path", "line").limit(1)
    u = usages(lines, first).select(F.lit("usage").alias("role"), "path", "line")
    return d.select(F.lit("definition").alias("role"), "path", "line").unionByName(u)


def patterns(lines: DataFrame, rules: list[tuple[str, list[str]]] = PATTERNS) -> DataFrame:
    """(path, line, kind, context); a line can be of several kinds."""
    t = X.trim("text")
    kinds = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]), F.lit(kind)) for kind, words in rules]))
    return lines.filter(~is_comment(t)).select("path", "line", F.explode(kinds).alias("kind"), X.truncate_bytes(t, 100).alias("context"))


def pattern_inventory(found: DataFrame, shown: int = 5) -> DataFrame:
    w = Window.partitionBy("kind")
    return found.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("path", "line"))).filter(F.col("rank") <= shown)


def usages_by_file(found: DataFrame, shown: int = 5) -> DataFrame:
    w = Window.partitionBy("name", "path")
    return found.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("line"))).filter(F.col("rank") <= shown)


def usages_in_files(lines: DataFrame, syms: DataFrame) -> DataFrame:
    """(name, path, line, n): of the usages of a name in a file the first line and the number, without forming them.

    A line with the name is a usage of every definition but one at its own place, so sums by name and
    file say it all.
    """
    own = syms.groupBy("name", "path", "line").agg(F.count("*").alias("here"))
    defs = syms.groupBy("name").agg(F.count("*").alias("defs"))
    at = identifiers(lines).join(defs, "name").join(own, ["name", "path", "line"], "left").withColumn("n", F.col("defs") - F.coalesce("here", F.lit(0)))
    return at.filter("n > 0").groupBy("name", "path").agg(F.min("line").alias("line"), F.sum("n").alias("n"))


def imports(lines: DataFrame) -> DataFrame:
    """(path, modules): what each file imports, sorted."""
    t, ext = X.trim("text"), extension(F.col("path"))
    used = F.regexp_extract(t, r"^use (?:crate)?([^:]*)", 1)
    mod = F.regexp_extract(t, r"^mod ([^{]*?)\s*;*$", 1)
    rust = F.when(used.rlike("^.{2,}"), used).when(mod.rlike("^.{2,}"), mod)
    swift = F.nullif(F.regexp_extract(t, r"^import (.*)$", 1), F.lit(""))
    c = F.nullif(F.regexp_extract(t, r'^#(?:include|import)[^"<]*["<]([^">]*)', 1), F.lit(""))
    m = F.when(ext == "rs", rust).when(ext == "swift", swift).when(ext.isin("metal", "h", "c", "m"), c)
    return lines.select("path", m.alias("module")).filter("module is not null").groupBy("path").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def module_map(lines: DataFrame, syms: DataFrame, found: DataFrame) -> DataFrame:
    """(path, lines, symbols, patterns) per file."""
    n = lines.groupBy("path").agg(F.count("*").alias("lines"))
    s = syms.groupBy("path").agg(F.count("*").alias("symbols"))
    p = found.groupBy("path").agg(F.count("*").alias("patterns"))
    return n.join(s, "path", "left").join(p, "path", "left").na.fill(0, ["symbols", "patterns"])


def analyze(lines: DataFrame, topic: str, ts_min: int) -> DataFrame:
    """The project report as entries (topic, body, ts_min): modules, symbols, coupling, patterns, imports."""
    syms, found = symbols(lines), patterns(lines)

    def report(kind: str, rows: DataFrame, text: Column, order: list) -> DataFrame:
        sort = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
        every = F.array_sort(F.collect_list(F.struct(sort.alias("sort"), text.alias("text"))))
        whole = rows.agg(F.array_join(F.transform(every, lambda x: x["text"]), "\n").alias("t"))
        return whole.select(F.lit(topic).alias("topic"), F.concat(F.lit(f"[tags: {kind}]\n[confidence: 0.8]\n"), "t").alias("body"), F.lit(ts_min).alias("ts_min"))

    c = F.col
    parts = [
        report("module-map", module_map(lines, syms, found), F.concat_ws(" ", "path", c("lines").cast("string"), c("symbols").cast("string")), [-c("lines"), c("path")]),
        report("symbols", syms, F.concat_ws(" ", "kind", "name", "path"), [c("path"), c("line")]),
        report("coupling", coupling(lines, syms).orderBy(F.desc("n"), "a", "b").limit(15), F.concat_ws(" ", "a", "b", c("n").cast("string")), [-c("n"), c("a"), c("b")]),
        report("pattern", pattern_inventory(found), F.concat_ws(" ", "kind", "path", c("line").cast("string")), [c("kind"), c("path"), c("line")]),
        report("dependencies", imports(lines), F.concat("path", F.lit(": "), F.array_join("modules", ", ")), [c("path")]),
    ]
    return reduce(DataFrame.unionByName, parts)


def is_build(command: Column | str) -> Column:
    """The command builds something."""
    c = X.col(command)
    return (F.contains(c, F.lit("xcodebuild")) & F.contains(c, F.lit("build"))) | c.rlike("cargo build|swift build|swiftc ")


def has_error(output: Column | str) -> Column:
    """The output tells of an error or a failed build."""
    return X.col(output).rlike(r"error:|error\[E|BUILD FAILED|\*\* FAILED \*\*")


def build_errors(outputs: DataFrame, most: int = 5, failures: int = 3) -> DataFrame:
    """(id, at, error): distinct error lines of each output (id, output), a few each, in order; without any, its lines of failure."""
    rows = outputs.select("id", F.posexplode(F.split("output", r"\\n|\n")).alias("at", "error")).withColumn("error", X.trim("error"))
    error = F.contains("error", F.lit(": error:")) | F.contains("error", F.lit("error[E"))
    failed = F.col("error").rlike(r"BUILD FAILED|\*\* FAILED \*\*|aborting")
    hit = rows.withColumn("sort", F.when(error, 0).when(failed, 1)).filter("sort is not null")
    once = hit.groupBy("id", "sort", F.when(F.col("sort") == 0, F.lit(0)).otherwise(F.col("at")).alias("each"), "error").agg(F.min("at").alias("at"))
    w = Window.partitionBy("id")
    kept = once.withColumn("first", F.min("sort").over(w)).filter("sort = first").withColumn("rank", F.row_number().over(w.orderBy("at")))
    return kept.filter(F.col("rank") <= F.when(F.col("sort") == 0, most).otherwise(failures)).select("id", "at", X.truncate_bytes(F.col("error"), 200).alias("error"), "rank")


def build_notes(calls: DataFrame) -> DataFrame:
    """(id, topic, body): what is stored by itself of build calls (id, command, output) that failed."""
    failed = calls.filter(is_build("command") & has_error("output"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "error"))), lambda x: x["error"]), "\n")
    return build_errors(failed).groupBy("id").agg(F.concat(F.lit("[tags: auto, build-error]\n"), lines).alias("body")).select("id", F.lit("build-errors").alias("topic"), "body")


def listing(lines: DataFrame, glob: str, limit: int = 50) -> DataFrame:
    """(path): files whose name matches the glob (``*`` any text, ``?`` a character), the first in order."""
    name = F.substring_index("path", "/", -1)
    pattern = glob.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return lines.filter(name.like(pattern)).select("path").distinct().orderBy("path").limit(limit)


def benchmark_lines(outputs: DataFrame, most: int = 20, least: int = 2) -> DataFrame:
    """(id, at, line): timing and throughput lines of outputs that have at least two."""
    rows = outputs.select("id", F.posexplode(F.split("output", r"\\n|\n")).alias("at", "line")).withColumn("line", X.trim("line"))
    noise = F.contains("line", F.lit(": error:")) | F.contains("line", F.lit("warning:")) | F.col("line").rlike("^(Compiling|Linking|Finished)")
    rate = F.col("line").rlike("(tok|tokens|GB|MB|it)/s")
    hit = rows.filter((F.octet_length("line") >= 5) & ~noise & (X.has_timing("line") | rate))
    w = Window.partitionBy("id")
    return hit.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("at"))).filter((F.col("n") >= least) & (F.col("rank") <= most)).select("id", "at", X.truncate_bytes(F.col("line"), 150).alias("line"))
