"""Personal data: patterns with checks, and terms that give protected entities away. DataFrame operations only.

*Base spans.* Four kinds of value are found leftmost and non-overlapping per kind; matches that fail their check are dropped. Texts are
worked on in pieces of ``PIECE`` code points or a little more, cut where no match of any kind and no word can go on, so the work grows with
the length of a text and not with the square of its matches.

*Disclosure.* The corpus tells how strongly a term reveals an entity. The context of a base value is the last and first ``NEAR`` terms
before and after it, on its line and within ``REACH`` code points. For a term t (a run of letters; a single character in scripts that are written without
spaces) and an entity e (a base value, lower-cased), n(t,e) is the number of documents in which t stands in a context of e, n(t) and n(e)
are document counts over all documents, N their number; rows that repeat a doc_id and text are one document. t discloses e if n(t,e) is
``support`` at least, if P(e|t) = n(t,e)/n(t) is at least ``share``, and if the pointwise information log2(P(e|t) / P(e)) is at least
``bits``. One document is enough by default: share and bits decide. Such terms are generalised to ``[TERM]``, or removed, wherever they
stand in any document.

Term counts are combined per task before they are shuffled. All that every task gets is a bitmap of 2**20 buckets, whose size is fixed; it
thins out the words of each text before they become rows, and texts before they are joined. Exact joins follow.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._space import Space

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that a search is linear: a run of characters is tried from its start (or from where the last match
#: ended) only, and repeats that can't give anything back are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BUCKETS = 1 << 20
PIECE = 2000
NEAR = 8
REACH = 200
#: A piece ends behind a character that is neither a letter nor in any pattern, behind a space that follows a letter, or before a plus sign that
#: follows a space. A stretch without such a place stays one piece.
_CUT = rf"(?s).{{{PIECE}}}.*?(?:[^\p{{L}}\p{{M}}0-9._%+@()\x20-]|\p{{L}}\x20|\x20(?=\+)|\z)|.+"
#: Scripts without spaces between words.
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_RUN = rf"[\p{{L}}&&[^{_DENSE}]]+|[\p{{L}}&&[{_DENSE}]]"
_TERM = rf"[\p{{L}}&&[^{_DENSE}]]{{2,}}|[\p{{L}}&&[{_DENSE}]]"
_SPANS = "array<struct<k:int,start:int,end:int,value:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _zipped(gaps: Column, values: Column) -> Column:
    """Array of (gap, value): each value with the text before it."""
    return F.filter(F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull() & x["gap"].isNotNull())


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        # Luhn: from the right, every second digit is doubled and its own digits are added.
        places = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
        return F.when(F.length(digits).between(16, 19), F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)
    return F.lit(True)


def _placed(piece: Column, pattern: str, k: int, good) -> Column:
    """Array of (k, start, end, value) of the matches of a pattern in a piece that are ``good``."""
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        here = F.struct(F.lit(k).alias("k"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(good(x["value"]), F.concat(acc["spans"], F.array(here))).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    return F.aggregate(_zipped(F.split(piece, pattern, -1), F.regexp_extract_all(piece, F.lit(pattern), 0)), begin, step, lambda a: a["spans"])


def _may(text: Column) -> dict[str, Column]:
    """Cheap conditions that every match meets, so that most texts aren't searched for a kind."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){16}"), "phone": text.rlike(r"\+[0-9]")}


def _any(text: Column) -> Column:
    some = _may(text)
    return some["email"] | some["ip"] | some["card"] | some["phone"]


def _base(piece: Column) -> Column:
    """The spans of all kinds in a piece, by kind as listed, then start."""
    some = _may(piece)
    return F.concat(*[F.when(some[kind], _placed(piece, PATTERNS[kind], k, lambda v, kind=kind: _valid(kind, v))).otherwise(F.array().cast(_SPANS)) for k, kind in enumerate(KINDS)])


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CUT), 0)


def _starts(pieces: Column) -> Column:
    """Where each piece begins."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(pieces, F.char_length), begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _shifted(spans: Column, at: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["k"].alias("k"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))


def _words(text: Column) -> Column:
    """Distinct terms: runs of at least two letters, in lower case; single characters where a script has no spaces."""
    # Cutting what lies between runs out of the text in lower case is several times faster; the capital that lower case takes apart is looked at alone.
    plain = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.char_length(w) >= 2)
    return F.when(text.rlike(f"[{_DENSE}\u0130]"), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), 0), F.lower))).otherwise(plain)


def _contexts(pieces: Column) -> Column:
    """Array of (entity, terms) of the base values of a text."""
    def around(piece: Column, i: Column) -> Column:
        before = F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(REACH))).otherwise(F.lit(""))
        whole = F.concat(before, piece, F.coalesce(F.left(F.get(pieces, i + 1), F.lit(REACH)), F.lit("")))

        def of(s: Column, w: Column) -> Column:
            start, end = s["start"] + F.char_length(w["before"]), s["end"] + F.char_length(w["before"])
            left = F.substring(w["whole"], F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH)))
            right = F.substring(w["whole"], end + 1, F.lit(REACH))
            # A run that reaches the border may go on behind it.
            left = F.substring_index(F.when(start > REACH, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left), "\n", -1)
            right = F.substring_index(F.when(F.char_length(right) == REACH, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right), "\n", 1)
            bare = lambda c: F.regexp_extract_all(F.regexp_replace(c, r"[A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*+", " "), F.lit(_TERM), 0)
            terms = _let(F.struct(bare(left).alias("l"), bare(right).alias("r")), lambda x: F.concat(F.slice(x["l"], F.greatest(F.size(x["l"]) - NEAR, F.lit(0)) + 1, F.lit(NEAR)), F.slice(x["r"], F.lit(1), F.lit(NEAR))))
            return F.struct(F.lower(s["value"]).alias("entity"), F.array_distinct(F.transform(terms, F.lower)).alias("terms"))

        return _let(F.struct(before.alias("before"), whole.alias("whole")), lambda w: F.transform(_base(piece), lambda s: of(s, w)))

    return F.flatten(F.transform(pieces, around))


def _bitmap(keys: DataFrame) -> Column:
    """The buckets of ``keys`` (key long), as a constant of 64-bit words; at most BUCKETS / 64 rows come to the driver."""
    bucket = F.pmod("key", F.lit(BUCKETS))
    bits = keys.groupBy(F.floor(bucket / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {BUCKETS}) % 64 as int))")).alias("bits")).collect()
    words = [0] * (BUCKETS // 64)
    for r in bits:
        words[r["word"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def _in(bitmap: Column, key: Column) -> Column:
    bucket = F.pmod(key, F.lit(BUCKETS))
    return F.getbit(F.get(bitmap, F.floor(bucket / 64).cast("int")), (bucket % 64).cast("int")) == 1


def disclosing_terms(docs: DataFrame, space: Space, support: int, share: float, bits: float) -> DataFrame:
    """``docs`` (k1, k2, text) -> (k1, k2, terms): the disclosing terms of each document that holds any."""
    n_docs = docs.select("k1", "k2").distinct().count()
    cut = docs.where(_any(F.col("text"))).withColumn("pieces", _pieces(F.col("text")))
    held = space.save(cut.select("k1", "k2", _contexts(F.col("pieces")).alias("met")), "contexts")
    each = held.select("k1", "k2", F.explode("met").alias("m")).select("k1", "k2", F.col("m.entity").alias("entity"), F.col("m.terms").alias("terms"))
    entities = each.select("k1", "k2", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = space.save(each.select("k1", "k2", "entity", F.explode("terms").alias("term")).distinct(), "pairs")
    # A term is in at least as many documents as in those where it stands by any value: most pairs can't reach the share, and go.
    met = pairs.select("k1", "k2", "term").distinct().groupBy("term").agg(F.count("*").alias("n_met"))
    both = pairs.groupBy("term", "entity").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    both = space.save(both.join(met, "term").where(F.col("n_both") >= share * F.col("n_met")).drop("n_met"), "both")

    def standing(texts: DataFrame, pairs: DataFrame) -> DataFrame:
        """(k1, k2, term): the documents' words that may be terms of the pairs."""
        bitmap = _bitmap(pairs.select(F.xxhash64("term").alias("key")))
        return texts.select("k1", "k2", F.explode(F.filter(_words(F.col("text")), lambda w: _in(bitmap, F.xxhash64(w)))).alias("term"))

    # The same with all their words, then with all documents.
    low = standing(docs.where(_any(F.col("text"))), both).distinct().groupBy("term").agg(F.count("*").alias("n_low"))
    both = space.save(both.join(low, "term").where(F.col("n_both") >= share * F.col("n_low")).drop("n_low"), "likely")
    some = space.save(standing(docs, both), "candidates")
    counts = some.distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    told = both.join(counts, "term").join(entities, "entity")
    p = F.col("n_both") / F.greatest("n_term", "n_both")
    terms = told.where((p >= share) & (F.log2(p * n_docs / F.col("n_entity")) >= bits)).select("term").distinct()
    return space.save(some.join(terms, "term").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("term")).alias("terms")), "hits")


def personal_data(docs: DataFrame, support: int = 1, share: float = 0.9, bits: float = 6.0, mode: str = "generalise") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, text, clean_text.

    ``spans`` lists kind:start:end (code points, end exclusive), the four kinds first, then the added kind ``term``; ``clean_text`` has
    base values replaced by ``[EMAIL]`` and so on, and disclosing terms by ``[TERM]`` (``mode`` 'generalise') or nothing
    ('remove'); where spans overlap, the union is replaced once, by the mark of the first. A null text is an empty one in
    all but ``text`` and ``clean_text``, which stay null. Repeated rows give repeated results; nulls in doc_id are kept. Of extra columns, those
    named like results are replaced and the others left alone, whatever their names. An empty table gives an empty result. Texts may be
    of any length.
    """
    spark: SparkSession = docs.sparkSession
    space = Space(spark, "pii")
    results = ("doc_id", "text", *(f"n_{k}" for k in KINDS), "n_term", "base_sha256", "spans", "clean_text")
    extra = [c for c in docs.columns if c.lower() not in results]
    rest = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)])
    doc_id = F.col("doc_id").cast("long")
    # 128 bits name a document, so that two of them are never taken for one.
    docs = docs.select(doc_id.alias("doc_id"), "text", rest.alias("rest"), F.xxhash64(doc_id, "text").alias("k1"), F.xxhash64(F.lit(1), "text", doc_id).alias("k2"))
    hits = disclosing_terms(docs.select("k1", "k2", "text"), space, support, share, bits)

    near = _in(_bitmap(hits.select(F.col("k1").alias("key"))), F.col("k1"))
    none = F.array().cast("array<string>")
    some = docs.where(near).join(hits, ["k1", "k2"], "left").withColumn("terms", F.coalesce("terms", none))
    both = some.select("doc_id", "text", "rest", "terms").unionByName(docs.where(~near).select("doc_id", "text", "rest", none.alias("terms")))
    both = both.withColumn("pieces", F.when(_any(F.col("text")) | (F.size("terms") > 0), _pieces(F.col("text"))).otherwise(none))

    def added(piece: Column) -> Column:
        own = lambda o: F.when(F.size(o) > 0, _placed(piece, _RUN, len(KINDS), lambda v: F.array_contains(o, F.lower(v)))).otherwise(F.array().cast(_SPANS))
        return F.when(F.size("terms") > 0, _let(F.array_intersect(_words(piece), F.col("terms")), own)).otherwise(F.array().cast(_SPANS))

    both = both.withColumn("parts", F.zip_with("pieces", _starts(F.col("pieces")), lambda p, at: F.struct(p.alias("piece"), at.alias("at"), _base(p).alias("base"), added(p).alias("added"))))
    gathered = lambda name: F.flatten(F.transform("parts", lambda p: _shifted(p[name], p["at"])))
    both = both.withColumn("base", F.sort_array(gathered("base"))).withColumn("added", gathered("added"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")

    # The union of all spans of a piece in order of place; each stretch is replaced by the mark of the span it begins with.
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]" if mode == "generalise" else ""))

    def cleaned(p: Column) -> Column:
        def cut(acc: Column, s: Column) -> Column:
            out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(p["piece"], acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["k"])))).otherwise(acc["out"])
            return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), out.alias("out"))

        ordered = F.sort_array(F.transform(F.concat(p["base"], p["added"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(ordered, begin, cut, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(p["piece"], a["at"] + 1, F.char_length(p["piece"]))))

    clean = F.when(F.size("base") + F.size("added") > 0, F.array_join(F.transform("parts", cleaned), "")).otherwise(F.col("text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long")
    return both.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_term"), "text", clean.alias("clean_text"), *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(extra)],
    )
