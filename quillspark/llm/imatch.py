"""Document fingerprints by I-Match with randomised lexicons, in DataFrame operations only.

The base lexicon holds the terms whose document frequency lies between ``rare`` and ``common`` times the number of documents (a band of
inverse document frequency). At most (mean number of distinct terms per document) / ``rare`` terms can reach the lower bound, so it
doesn't grow with the corpus; it is broadcast only if it has at most ``held`` terms. Randomised lexicons are fixed subsets of
it, the same for every document: ``FAMILIES`` independent ones for each density 2**-d, d in ``DEPTHS``. A term's hash alone says which ones
it is in: a family has sixteen bits of a hash of it, and keeps it at density 2**-d if the d lowest of them are zero.

A document's fingerprint has one value for each lexicon and one for the whole band: its distinct terms that the lexicon holds, sorted, are hashed as
one. Dense lexicons tell small edits apart, sparse ones agree after large edits, and which ones do so depends on how many terms a document
has. So the likeness of two fingerprints is that of the density at which they agree most: of its lexicons in which either has a term, the share whose
hashes agree, if that is a quarter of its lexicons at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm._order import Blocks, next_blocks
from quillspark.llm._space import Space

FAMILIES = 16
DEPTHS = range(2, 11)


def _terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits, in lower case."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, rare: float, common: float) -> DataFrame:
    """Hashes of the terms whose share of documents lies in the band; at least two documents."""
    n = docs.count()
    counts = docs.select(F.explode(_terms(F.col("text"))).alias("term")).where("term <> ''").groupBy(F.xxhash64("term").alias("term")).agg(F.count("*").alias("df"))
    return counts.where((F.col("df") >= max(2.0, rare * n)) & (F.col("df") <= max(2.0, common * n))).select("term")


def fingerprint(terms: str) -> Column:
    """The hashes of an array of sorted distinct term hashes (one at least): of the whole, then by family and density; 0 where a lexicon has none of them.

    The lexicons of a family are nested, so each is filtered from the one before.
    """
    hashed = "transform(array(filter(s.left, h -> (shiftright(h, 16 * f) & (shiftleft(1L, d) - 1)) = 0)), l -> named_struct('left', l, 'out', concat(s.out, array(if(size(l) = 0, 0, hash(l))))))[0]"
    family = f"aggregate(sequence({DEPTHS[0]}, {DEPTHS[-1]}), named_struct('left', own, 'out', cast(array() as array<int>)), (s, d) -> {hashed}, s -> s.out)"
    four = f"transform(array(transform({terms}, h -> xxhash64(h, g))), own -> flatten(transform(sequence(0, 3), f -> {family})))[0]"
    return F.expr(f"concat(array(hash({terms})), flatten(transform(sequence(0, {FAMILIES // 4 - 1}), g -> {four})))")


def as_text(fp: str) -> Column:
    """A fingerprint as hexadecimal digits, eight for each lexicon; lexicons that hold none of the terms are left empty between commas."""
    return F.expr(f"array_join(transform({fp}, h -> if(h = 0, '', lower(lpad(hex(cast(h as bigint) & 4294967295L), 8, '0')))), ',')")


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    n = len(DEPTHS)
    met = f"zip_with({a}, {b}, (p, q) -> if(p = 0 and q = 0, null, p = q))"
    share = f"transform(array(filter(m, (x, i) -> i > 0 and (i - 1) % {n} = d and x is not null)), o -> if(size(o) * 4 < {FAMILIES}, 0D, size(filter(o, x -> x)) / size(o)))[0]"
    return F.expr(f"case when {a} = {b} then 1D else transform(array({met}), m -> array_max(transform(sequence(0, {n - 1}), d -> {share})))[0] end").cast("double")


def edited_fingerprints(docs: DataFrame, rare: float = 0.001, common: float = 0.1, held: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, in
    ascending (doc_id, text) order; after the last comes the first, and a single document is its own next. A null text is an
    empty one; rows without a doc_id come first, in the order of a hash of their text. Repeated rows follow one another. A text without
    lexicon terms has its hash as its only term: equal texts still agree. Other columns are not looked at; an empty table gives an empty
    result.
    """
    spark: SparkSession = docs.sparkSession
    space = Space(spark, "imatch")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lex = space.save(lexicon(docs, rare, common), "lexicon")
    small = lex.count() <= held  # 16 bytes or so each, in a hash table
    lex = lex.union(spark.range(1).select(F.lit(0).cast("long").alias("term")))

    other = F.xxhash64("text")
    placed = docs.withColumn("block", Blocks(docs.select("doc_id"), "doc_id").of(other))
    placed = placed.withColumn("key", F.coalesce("doc_id", other))
    after = space.save(next_blocks(placed.select("block")), "next")
    order = Window.partitionBy("block").orderBy("key", "text")
    rows = placed.withColumn("rn", F.row_number().over(order))
    led = rows.withColumn("next_text", F.lead("text").over(order)).join(_firsts(rows, after, "text"), "block")
    half = F.floor(F.char_length("text") / 2).cast("int")
    pairs = led.select("block", "rn", "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), half.alias("half"), F.coalesce("next_text", "first_value").alias("next_text"))
    pairs = pairs.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - half), left(next_text, half))"))
    both = pairs.select("block", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("side", "body"))
    tokens = both.select("block", "rn", "doc_id", "n_chars", "edited_sha256", "side", F.xxhash64("body").alias("own"), F.explode(F.concat(F.array(F.lit("")), _terms(F.col("body")))).alias("word"))
    tokens = tokens.withColumn("term", F.when(F.col("word") == "", F.lit(0).cast("long")).otherwise(F.xxhash64("word")))
    met = tokens.join(F.broadcast(lex) if small else lex, "term")
    one = lambda side: F.array_remove(F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("term")))), 0)
    own = lambda side: F.max(F.when(F.col("side") == side, F.col("own")))
    sets = met.groupBy("block", "rn").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("edited_sha256").alias("edited_sha256"), one(0).alias("t0"), one(1).alias("t1"), own(0).alias("h0"), own(1).alias("h1"))
    for k in "01":
        sets = sets.withColumn(f"t{k}", F.expr(f"if(size(t{k}) = 0, array(h{k}), t{k})"))
    made = sets.withColumn("f0", fingerprint("t0")).withColumn("f1", fingerprint("t1")).drop("t0", "t1", "h0", "h1")
    made = space.save(made, "made")

    inner = Window.partitionBy("block").orderBy("rn")
    led = made.withColumn("f_next", F.lead("f0").over(inner)).join(_firsts(made, after, "f0"), "block").withColumn("f_next", F.coalesce("f_next", "first_value"))
    return led.select("doc_id", "n_chars", "edited_sha256", as_text("f0").alias("fingerprint"), as_text("f1").alias("edited_fingerprint"), likeness("f0", "f1").alias("near_edited"), likeness("f0", "f_next").alias("near_next"))


def _firsts(rows: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(block, first_value): ``column`` of the first row of the block after each block."""
    firsts = rows.where("rn = 1").select(F.col("block").alias("next_block"), F.col(column).alias("first_value"))
    return after.join(firsts, "next_block").select("block", "first_value")
