"""Documentation files: kinds, heads, outlines, mentions and links."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.storage import settled
from loomgraph.operators.resolve import unique_match
from loomgraph.sources.arguments import split
from loomgraph.sources.files import walk

#: Which of several files with one id counts.
PRECEDENCE = {"mdx": 0, "md": 1, "rst": 2}
#: Words of prose that are no mention of an entity of that name.
STOP_WORDS = tuple(
    """
    build new get set run main test init default from into len name id value type self str ok err none some string result
    error config data node graph list map key item args path file add remove update create delete read write open close
    start stop next iter size count index
    """.split()
)
#: Labels whose nodes documents mention, and those of them that own methods.
SYMBOL_LABELS = ("Function", "Class", "Struct", "Enum", "Trait", "Interface", "Constant")
CONTAINER_LABELS = ("Class", "Struct", "Enum", "Trait", "Interface")
#: RST roles that name code.
CODE_ROLES = ("func", "function", "meth", "method", "class", "obj", "attr", "data", "exc", "const", "member", "type")
#: A line that rules an RST title off, one character of these repeated.
ADORNMENT = r"""^([=\-`:'"~^_*+#<>.])\1+\s*$"""
#: The head of a Markdown document.
HEAD = r"^\uFEFF?---[ \t]*\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|$)"
#: Kinds of documents by their lower-case names (as patterns), the first that fits.
KINDS = (
    ("readme", "^readme"),
    ("changelog", "^changelog|^changes$|^history$|^whats-?new"),
    ("contributing", "^contributing"),
    ("license", "^licen[sc]e|^copying$"),
    ("code_of_conduct", "code[_-]of[_-]conduct"),
    ("security", "^security"),
    ("adr", "^adr"),
)


def kind_of(path: Column) -> Column:
    """A document's kind by its path without extension: by name, then by folder."""
    path = F.lower(path)
    name, out = F.element_at(F.split(path, "/"), -1), F.when(path.rlike("(?:^|/)docs?(?:/|$)"), "guide").otherwise("doc")
    for kind, pattern in reversed(KINDS):
        hit = name.rlike(pattern)
        out = F.when(hit | F.contains(path, F.lit("/adr")) if kind == "adr" else hit, kind).otherwise(out)
    return out


def documents(spark: SparkSession, root: str) -> DataFrame:
    """id (path without extension), path, kind, title, text; of files with one id the highest in precedence."""
    files = walk(spark, root).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).where(F.col("ext").isin(*PRECEDENCE))
    rank = F.create_map(*(F.lit(x) for kv in PRECEDENCE.items() for x in kv))[F.col("ext")]
    rows = files.select(F.regexp_replace("path", r"\.[A-Za-z]+$", "").alias("id"), "path", "ext", F.col("content").cast("string").alias("text"), rank.alias("_rank"))
    best = rows.groupBy("id").agg(F.min_by(F.struct("path", "ext", "text"), F.struct("_rank", "path")).alias("r")).select("id", "r.*")
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"(?m)^(\S[^\n]*)\n[=]{3,}\s*$", 1), F.lit("")), F.element_at(F.split("path", "/"), -1))
    return best.withColumn("kind", kind_of(F.col("id"))).withColumn("title", title)


def lines(docs: DataFrame) -> DataFrame:
    """id, path, ext, line, s: the lines of each document; those of a Markdown document in or at a code fence are left out."""
    every = docs.select("id", "path", "ext", F.posexplode(F.split("text", "\r?\n")).alias("line", "s"))
    fence = (F.col("ext") != "rst") & F.col("s").rlike(r"^\s*(?:```|~~~)")
    inside = F.sum(fence.cast("int")).over(Window.partitionBy("id").orderBy("line")) % 2 == 1
    return every.withColumn("_out", inside | fence).where("NOT _out").drop("_out")


def outline(docs: DataFrame, most: int = 64) -> DataFrame:
    """id, position (from 1), level, heading: the first `most` headings of each document (id, path, ext, text).

    Markdown: lines that begin with `#`, outside fences; the level is their number. RST: a line at the margin, at most 200 characters long, above a line
    of one repeated punctuation character that is no shorter; the level counts the styles (character, with or without a line above) by first use."""
    w = Window.partitionBy("id").orderBy("line")
    text = lines(docs)
    marks = text.where(F.col("ext") != "rst").select("id", "line", F.length(F.regexp_extract("s", r"^\s*(#+)", 1)).alias("level"), F.trim(F.regexp_extract("s", r"^\s*#+(.*?)\s*$", 1)).alias("heading")).where("level > 0 AND heading <> ''")
    ruled = lambda c: c.rlike(ADORNMENT)
    rst = text.where(F.col("ext") == "rst").withColumn("_next", F.lead("s").over(w)).withColumn("_before", F.lag("s").over(w)).withColumn("heading", F.trim("s"))
    titles = rst.where((F.col("heading") != "") & ~F.col("s").rlike(r"^\s") & (F.length("heading") <= 200) & ~ruled(F.col("s")) & ruled(F.col("_next")) & (F.length(F.rtrim("_next")) >= F.length("heading")))
    style = F.concat(F.substring("_next", 1, 1), F.coalesce(ruled(F.col("_before")) & (F.substring("_before", 1, 1) == F.substring("_next", 1, 1)), F.lit(False)).cast("string"))
    titles = titles.withColumn("_style", style).withColumn("_first", F.min("line").over(Window.partitionBy("id", "_style")))
    sections = titles.select("id", "line", F.dense_rank().over(Window.partitionBy("id").orderBy("_first")).alias("level"), "heading")
    return marks.unionByName(sections).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("id", "position", "level", "heading")


def headings(docs: DataFrame) -> DataFrame:
    """id, headings (the outline's headings in order, as a JSON list), first. Documents without any have no row."""
    listed = F.array_sort(F.collect_list(F.struct("position", "heading")))
    return outline(docs).groupBy("id").agg(F.to_json(F.transform(listed, lambda h: h["heading"])).alias("headings"), F.min_by("heading", "position").alias("first"))


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    text = text.split(" #")[0].rstrip()
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in split(text[1:-1])]
    if text[:1] == "{" and text[-1:] == "}":
        return {k.strip().strip("'\""): _scalar(v) for k, _, v in (x.partition(":") for x in split(text[1:-1]))}
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _block(rows: list[tuple[int, str]]):
    """A nested block: (indentation, text) of lines that belong together."""
    depth, out = rows[0][0], {}
    is_list = rows[0][1].startswith("-")
    items: list = []
    for i, (indent, text) in enumerate(rows):
        if indent != depth or is_list != text.startswith("-"):
            continue
        rest = next((k for k in range(i + 1, len(rows)) if rows[k][0] < depth or rows[k][0] == depth and rows[k][1].startswith("-") == is_list), len(rows))
        if is_list:
            items.append(_scalar(text[1:]))
            continue
        key, colon, value = text.partition(":")
        if colon:
            joined = value.strip() in (">", "|", ">-", "|-")
            below = rows[i + 1 : rest]
            out[key.strip().strip("'\"")] = (" " if ">" in value else "\n").join(t for _, t in below) if joined else _block(below) if below and not value.strip() else _scalar(value)
    return items if is_list else out


def frontmatter(text: str) -> dict[str, str]:
    """The columns of a YAML head: scalars as text, lists and maps as JSON; null values are left out. Anchors, tags and lists of maps aren't read."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    read = _block(rows) if rows else {}
    shown = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return {k: shown(v) for k, v in read.items() if v is not None} if isinstance(read, dict) else {}


def properties(docs: DataFrame) -> DataFrame:
    """id, properties (map): what stands between the `---` lines at the head of a Markdown document. Documents without a head have no row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            maps = [list(frontmatter(x).items()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.map_(pa.string(), pa.string()))], ["id", "properties"])

    heads = docs.where(F.col("ext") != "rst").select("id", F.regexp_extract("text", HEAD, 1).alias("head")).where("head <> ''")
    return heads.mapInArrow(run, "id string, properties map<string,string>")


def nodes(docs: DataFrame) -> DataFrame:
    """The documents' nodes: id, title, kind, path, headings, and a column for each key of their heads.

    As in a pivot, the keys are counted first and there may be no more of them than `spark.sql.pivotMaxValues`. A key that is a column of its own has `meta_` before it."""
    spark = docs.sparkSession
    heads = settled(properties(docs))
    most = int(spark.conf.get("spark.sql.pivotMaxValues"))
    keys = [r.k for r in heads.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"the documents' heads have more than {most} keys (spark.sql.pivotMaxValues)")
    own, taken = ["id", "title", "kind", "path", "headings"], set()
    rows = docs.select("id", "title", "kind", "path", "ext").join(headings(docs), "id", "left").join(heads, "id", "left")
    rows = rows.withColumn("title", F.coalesce(F.nullif(F.element_at("properties", "title"), F.lit("")), F.when(F.col("ext") == "rst", F.col("first")), "title"))
    more = []
    for k in keys:
        name = f"meta_{k}" if k.lower() in own else k
        if k != "title" and name.lower() not in taken:
            more.append(F.element_at("properties", k).alias(name))
            taken.add(name.lower())
    return rows.select(*own, *more)


def mentions(docs: DataFrame) -> DataFrame:
    """id, token, strong: names that a document may mean. Strong are spans in backticks, in RST literals and roles of code; a name with `::` in prose isn't."""
    name = r"[A-Za-z_][A-Za-z0-9_]*"
    text = lines(docs).where(F.col("ext") != "rst").select("id", "s")
    every = lambda column, pattern, group=1: F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(group)))
    path = lambda c: F.regexp_extract(c, rf"^{name}(?:(?:::|\.){name})*", 0)
    ticks = text.select("id", every("s", r"`([^`\n]+)`").alias("t")).select("id", path("t").alias("token"), F.lit(True).alias("strong"))
    prose = text.select("id", every("s", rf"{name}(?:::{name})+", 0).alias("token"), F.lit(False).alias("strong"))
    rst = docs.where(F.col("ext") == "rst")
    roles = rst.select("id", every("text", r"(:[a-zA-Z][a-zA-Z0-9_:+-]*:`[^`]+`)").alias("t")).select("id", F.lower(F.regexp_extract("t", r"([^:]*):`", 1)).alias("role"), F.regexp_extract("t", r"`([^`]+)`", 1).alias("t"))
    shown = F.coalesce(F.nullif(F.regexp_extract("t", r"<([^`]*)>", 1), F.lit("")), "t")
    roles = roles.where(F.col("role").isin(*CODE_ROLES)).select("id", path(F.trim(F.regexp_replace(F.trim(shown), "^~+", ""))).alias("token"), F.lit(True).alias("strong"))
    literals = rst.select("id", every("text", "``([^`]+)``").alias("t")).select("id", path("t").alias("token"), F.lit(True).alias("strong"))
    found = ticks.unionByName(prose).unionByName(roles).unionByName(literals).where("token <> ''")
    return found.groupBy("id", "token").agg(F.max("strong").alias("strong"))


def _segments(c: Column) -> Column:
    return F.split(c, r"::|\.")


def resolve_mentions(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """found (id, token, strong), symbols (id, title, label) -> src, dst, dst_label, strategy. The first that fits counts:

    exact: the token is a symbol's id. The rest is for strong tokens whose last name has three characters or more, no `_` before it and is no word of prose:
    suffix: the token's segments end one symbol's id alone; name: a token of several segments whose last one only one symbol has;
    module_level: its last segment is the name of one symbol alone that isn't in a type.

    Each distinct token is resolved once, and every join has one row a key on the symbols' side, so neither common names nor common tokens meet in pairs."""
    rank = F.array_position(F.array(*(F.lit(x) for x in SYMBOL_LABELS)), F.col("label"))
    symbols = settled(symbols.where(F.col("label").isin(*SYMBOL_LABELS)).select("id", "title", "label").distinct())
    tokens = settled(found.groupBy("token").agg(F.max("strong").alias("strong")).withColumn("segments", _segments(F.col("token"))).withColumn("last", F.element_at("segments", -1)))
    exact = tokens.join(symbols.groupBy(F.col("id").alias("token")).agg(F.min_by("label", rank).alias("label")), "token")
    exact = exact.select("token", F.col("token").alias("dst"), F.col("label").alias("dst_label"), F.lit("exact").alias("strategy"), F.lit(0).alias("order"))
    open_ = tokens.where(F.col("strong") & (F.length("last") >= 3) & ~F.col("last").startswith("_") & ~F.lower("last").isin(*STOP_WORDS))
    longer = open_.where(F.size("segments") > 1).select("token", "last", F.array_join("segments", ".").alias("suffix"))

    parts = _segments(F.col("id"))
    ends = symbols.select("id", "title", "label", parts.alias("parts")).where((F.size("parts") > 1) & (F.element_at("parts", -1) == F.col("title"))).join(longer.select(F.col("last").alias("title")).distinct(), "title", "left_semi")
    ends = ends.select("id", "label", F.explode(F.transform(F.sequence(F.lit(2), F.size("parts")), lambda n: F.array_join(F.slice("parts", -n, n), "."))).alias("suffix"))
    one = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("dst"), F.min("label").alias("dst_label")).where("n = 1").drop("n")
    shaped = lambda rows, strategy, order: rows.select("token", "dst", "dst_label", F.lit(strategy).alias("strategy"), F.lit(order).alias("order"))
    suffix = shaped(longer.join(one(ends, "suffix"), "suffix"), "suffix", 1)
    named = symbols.withColumnRenamed("title", "last")
    name = shaped(longer.join(one(named, "last"), "last"), "name", 2)
    owners = symbols.where(F.col("label").isin(*CONTAINER_LABELS)).select(F.col("id").alias("owner")).distinct()
    free = named.withColumn("owner", F.regexp_extract("id", r"^(.*)(?:::|\.)", 1)).join(owners, "owner", "left_anti")
    module_level = shaped(open_.join(one(free, "last"), "last"), "module_level", 3)
    best = exact.unionByName(suffix).unionByName(name).unionByName(module_level).groupBy("token").agg(F.min_by(F.struct("dst", "dst_label", "strategy"), "order").alias("b"))
    told = found.select(F.col("id").alias("src"), "token").join(best, "token").groupBy("src", F.col("b.dst").alias("dst"), F.col("b.dst_label").alias("dst_label"))
    order = F.array_position(F.array(*(F.lit(x) for x in ("exact", "suffix", "name", "module_level"))), F.col("b.strategy"))
    return told.agg(F.min_by("b.strategy", order).alias("strategy"))


def links(docs: DataFrame) -> DataFrame:
    """id, target, to_doc: where a document's links lead, as paths from the tree's root; images, anchors, other hosts and fenced code are left out.

    A link to a Markdown file, and an RST reference to a document, is one to a document: its target has no extension."""
    text = lines(docs).where(F.col("ext") != "rst").select("id", "path", F.explode(F.regexp_extract_all("s", F.lit(r'(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'), F.lit(1))).alias("t"), F.lit(False).alias("to_doc"))
    rst = docs.where(F.col("ext") == "rst").select("id", "path", F.explode(F.regexp_extract_all("text", F.lit(":doc:`([^`]+)`"), F.lit(1))).alias("t"), F.lit(True).alias("to_doc"))
    rst = rst.withColumn("t", F.trim(F.coalesce(F.nullif(F.regexp_extract("t", "<([^`]*)>", 1), F.lit("")), "t")))
    one = text.unionByName(rst).withColumn("t", F.split("t", "[#?]")[0]).where((F.col("t") != "") & ~F.contains("t", F.lit("://")) & ~F.col("t").startswith("mailto:"))
    parts = F.filter(F.split(F.concat(F.when(F.col("t").startswith("/"), "").otherwise(F.regexp_replace("path", "[^/]*$", "")), F.col("t")), "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    led = one.select("id", F.array_join(folded, "/").alias("target"), "to_doc").where("target <> ''")
    markdown = ~F.col("to_doc") & F.col("target").rlike(r"(?i)\.mdx?$")
    return led.select("id", F.when(markdown, F.regexp_replace("target", r"\.[A-Za-z]+$", "")).otherwise(F.col("target")).alias("target"), (F.col("to_doc") | markdown).alias("to_doc")).distinct()


def linked(docs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) from documents to documents by id, and from documents to files (id): by a file name that one file of the tree has."""
    to = settled(links(docs))
    base = lambda c: F.element_at(F.split(c, r"[/\\]"), -1)
    to_docs = to.where("to_doc AND id <> target").join(docs.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("id").alias("src"), F.col("target").alias("dst"))
    named = unique_match(to.where("NOT to_doc").select(F.col("id").alias("src"), base(F.col("target")).alias("name")), files.select(base(F.col("id")).alias("name"), F.col("id").alias("dst")), "name", "dst")
    return to_docs.distinct(), named.select("src", "dst").distinct()
