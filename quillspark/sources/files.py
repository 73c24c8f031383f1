"""Plain-text and feed files as read items, with stable ids."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.text import escape_html, file_stem, first_invalid, is_blank, strip_bom, unix_newlines
from quillspark.operators.order import number_in_order, sums_before
from quillspark.schemas import READ_ITEMS
from quillspark.sources.html import fragment_text

# The vocabularies of feed extensions.
CONTENT, CREATOR = "http://purl.org/rss/1.0/modules/content/ encoded", "http://purl.org/dc/elements/1.1/ creator"
BODIES = (CONTENT, "content", "description")
FIELDS = (*BODIES, "title", "link", "author", CREATOR, "pubDate")


def raw_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(input_path, kind, bytes) of the files under a path; paths lose scheme and leading slash. Spark's reader leaves empty files out, so they are listed."""
    bare = F.regexp_replace("path", "^[a-z]+:/*|^/+", "")
    full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(bare.alias("input_path"), F.lit(kind).alias("kind"), F.col("content").alias("bytes"))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    empty = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            empty.append((f.getPath().toString(), bytearray()))
    none = spark.createDataFrame(empty, "path string, bytes binary").select(bare.alias("input_path"), F.lit(kind).alias("kind"), "bytes")
    return full.where(F.octet_length("bytes") > 0).unionByName(none)


def read_text(files: DataFrame) -> DataFrame:
    """Read items of plain-text files (input_path, bytes): one document each. Invalid UTF-8 and NUL reject (the message is the byte's place), white space alone is no text."""
    text = F.expr("try_validate_utf8(cast(bytes as string))")
    rows = files.select("input_path", "bytes", text.alias("raw"))
    body = unix_newlines(strip_bom("raw"))
    bad = F.col("raw").isNull() | F.col("raw").contains("\0")
    status = F.when(bad, "rejected").when(is_blank(body), "no_text").otherwise("warning")
    code = F.when(F.col("raw").isNull(), "utf8").when(bad, "nul").when(status == "no_text", "no_text").otherwise("title_fallback")
    record = F.when(status == "warning", F.struct(file_stem("input_path").alias("title"), body.alias("content"), F.lit("txt").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("url", "author", "published_at_raw")]))
    offset = F.coalesce(first_invalid(F.when(F.col("raw").isNull(), F.col("bytes"))), F.octet_length(F.substring_index("raw", "\0", 1)).cast("long"))
    issue = F.struct(code.alias("code"), F.when(bad, offset.cast("string")).otherwise("").alias("message"), F.lit("").alias("region"))
    return rows.select("input_path", F.lit(0).cast("long").alias("record_ordinal"), status.alias("status"), record.alias("record"), F.array(issue).alias("issues"))


class _Feed:
    """Reads one feed strictly: XML 1.0 in UTF-8, no document type, one ``rss`` 2.0 with one channel; gathers each item's fields.

    At most ``depth`` levels and ``nodes`` elements, texts, comments and instructions.
    """

    def __init__(self, data: bytes, depth: int = 128, nodes: int = 1_000_000):
        self.depth, self.nodes, self.seen = depth, nodes, 0
        self.items: list[dict] = []
        self.path: list[str] = []
        self.channels = 0
        parser = expat.ParserCreate(encoding="UTF-8", namespace_separator=" ")
        parser.buffer_text = True
        parser.XmlDeclHandler = self._declaration
        parser.StartDoctypeDeclHandler = self._doctype
        parser.CommentHandler = parser.ProcessingInstructionHandler = self._node
        parser.StartElementHandler = self._start
        parser.EndElementHandler = self._end
        parser.CharacterDataHandler = self._data
        self.field: str | None = None
        try:
            parser.Parse(data, True)
        except expat.ExpatError as e:
            raise EngineError("rss.xml", str(e)) from None
        if self.channels != 1:
            raise EngineError("rss.structure", "a feed has exactly one channel")

    def _doctype(self, *_a) -> None:
        raise EngineError("rss.dtd", "document types are not read")

    def _declaration(self, version: str, encoding: str | None, _standalone: int) -> None:
        if version != "1.0":
            raise EngineError("rss.declaration", "XML 1.0 only")
        if encoding is not None and encoding.lower() != "utf-8":
            raise EngineError("rss.declaration", "UTF-8 only")

    def _node(self, *_a) -> None:
        self.seen += 1
        if self.seen > self.nodes:
            raise EngineError("rss.nodes", "too many nodes")

    def _start(self, name: str, attrs: dict) -> None:
        self._node()
        self.path.append(name)
        if len(self.path) > self.depth:
            raise EngineError("rss.depth", "too many levels")
        if len(self.path) == 1 and (name != "rss" or attrs.get("version") != "2.0"):
            raise EngineError("rss.structure", "not an RSS 2.0 feed")
        if self.path == ["rss", "channel"]:
            self.channels += 1
        if self.path == ["rss", "channel", "item"]:
            self.items.append({"fields": {}, "twice": False, "nested": False})
        if self.path[:3] == ["rss", "channel", "item"] and len(self.path) == 4 and name in FIELDS:
            item = self.items[-1]
            item["twice"] |= name in item["fields"]
            item["fields"][name] = ""
            self.field = name
        elif self.field is not None:
            self.items[-1]["nested"] = True

    def _end(self, _name: str) -> None:
        if len(self.path) == 4:
            self.field = None
        self.path.pop()

    def _data(self, data: str) -> None:
        self._node()
        if self.field is not None and len(self.path) == 4:
            self.items[-1]["fields"][self.field] += data


_WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def feed_items(path: str, data: bytes) -> list[tuple]:
    """Read items of one feed; a feed that isn't well-formed is one failed item, one without items has no text."""
    issue = lambda code, message="", region="": {"code": code, "message": message, "region": region}
    try:
        data.decode()
        feed = _Feed(data)
    except UnicodeDecodeError as e:
        return [(path, 0, "failed", None, [issue("utf8", str(e.start))])]
    except EngineError as e:
        return [(path, 0, "failed", None, [issue("malformed_input", e.message, e.context)])]
    if not feed.items:
        return [(path, 0, "no_text", None, [issue("no_text")])]
    stem = path.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
    rows = []
    for k, item in enumerate(feed.items):
        f, issues = item["fields"], []
        if item["twice"] or item["nested"]:
            rows.append((path, k, "rejected", None, [issue("duplicate_field" if item["twice"] else "nested_field")]))
            continue
        text, used = "", None
        for name in BODIES:
            if name in f:
                text, recovered = fragment_text(f[name])
                if text:
                    used = name
                    if recovered:
                        issues.append(issue("malformed_input"))
                    break
        if used is None:
            rows.append((path, k, "no_text", None, [issue("no_text")]))
            continue
        if used != CONTENT:
            issues.append(issue("missing_metadata"))
        title = f.get("title", "").strip(_WHITE)
        if not title:
            title = f"{stem}#{k}"
            issues.append(issue("title_fallback"))
        record = {"title": title, "content": text, "kind": "rss", "url": f.get("link"), "author": f.get(CREATOR, f.get("author")), "published_at_raw": f.get("pubDate")}
        rows.append((path, k, "warning" if issues else "success", record, issues))
    return rows


def read_feeds(files: DataFrame) -> DataFrame:
    """Read items of feeds (input_path, bytes); no bytes are an empty file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, b in zip(batch["input_path"], batch["bytes"], strict=True) for r in feed_items(p, b"" if b is None else bytes(b))]
            yield pd.DataFrame(rows, columns=["input_path", "record_ordinal", "status", "record", "issues"])

    return files.select("input_path", "bytes").mapInPandas(run, READ_ITEMS)


def xml_forbidden(c: Column) -> Column:
    """Whether a string holds characters that XML 1.0 can't."""
    return c.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ufffe\uffff]")


def feeds(pages: DataFrame, most: int = 1000) -> DataFrame:
    """(feed, items, xml): RSS 2.0 feeds of pages (input_path, title, url, content) in order of their paths, ``most`` items each.

    Texts are kept as they are: a reader of the feed gets the same content again. Pages without text, or with characters that XML can't hold, are left out.
    """
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), "content")
    good = pages.where(F.col("content").isNotNull() & ~is_blank("content") & ~xml_forbidden(text)).select("input_path", "title", "url", "content")
    body = escape_html(F.concat(F.lit("<pre>"), escape_html("content"), F.lit("</pre>")))
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("<link>"), escape_html("url"), F.lit("</link>"))).otherwise("")
    item = F.concat(F.lit("<item><title>"), escape_html(F.coalesce("title", F.lit(""))), F.lit("</title>"), link, F.lit("<description>"), body, F.lit("</description></item>"))
    placed = number_in_order(good.withColumn("item", item), "input_path", "at").withColumn("feed", F.floor(F.col("at") / most).cast("long"))
    gathered = placed.groupBy("feed").agg(F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct("at", "item"))).alias("rows"))
    head, foot = '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>pages</title>', "</channel></rss>"
    return gathered.select("feed", "items", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["item"]), ""), F.lit(foot)).alias("xml"))


def read_counts(items: DataFrame) -> DataFrame:
    """(status, items)."""
    return items.groupBy("status").agg(F.count("*").alias("items"))


def until_failure(items: DataFrame) -> DataFrame:
    """The items before the first that failed, in source order: the 'stop' policy. Only the first failure's place is gathered."""
    first = items.where("status = 'failed'").agg(F.min(F.struct("input_path", "record_ordinal")).alias("stop"))
    return items.crossJoin(F.broadcast(first)).where(F.col("stop").isNull() | (F.struct("input_path", "record_ordinal") < F.col("stop"))).drop("stop")


def documents(items: DataFrame) -> DataFrame:
    """Delivered documents with ids: paths in byte order; each takes as many ids as it has items, one at least, whether or not they were delivered."""
    paths = items.groupBy("input_path").agg((F.max("record_ordinal") + 1).alias("n"))
    paths = sums_before(paths, ["input_path"], F.col("n"), "base").select("input_path", "base")
    out = items.where("record is not null").join(paths, "input_path")
    return out.select((F.col("base") + F.col("record_ordinal")).cast("long").alias("doc_id"), "input_path", "record_ordinal", "record.kind", "record.title", "record.content", "record.url", "record.author", "record.published_at_raw")


def stop_words(lines: list[str]) -> frozenset[str]:
    """A stop-word list from lines: each normalised, blanks ignored; a word with inner space is an error, '#' is a literal."""
    out = set()
    for k, line in enumerate(lines):
        word = " ".join(w for w in _split_white(line.removeprefix(chr(0xFEFF)) if k == 0 else line))
        word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
        if " " in word:
            raise EngineError("stopwords.entry", f"line {k + 1} holds more than one word")
        if word:
            out.add(word)
    return frozenset(out)


def _split_white(line: str) -> list[str]:
    for c in _WHITE:
        line = line.replace(c, " ")
    return [w for w in line.split(" ") if w]
