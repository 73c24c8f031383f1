"""From input files to a published snapshot in one call, with a report; also ``python -m quillspark.indexer``."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.limits import PROFILE_1, Limits, admit_items, check_files, check_terms, within
from quillspark.operators import fingerprints, index, suggest, terms
from quillspark.snapshot import Snapshot, publish
from quillspark.sources import files
from quillspark.storage import written

# Exit codes of the command.
DONE, USAGE, INPUT, LIMIT, WRITE = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Branch:
    """The inputs of a branch: folders of plain-text files and of feeds, and its stop-words."""

    txt: tuple[str, ...] = ()
    rss: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Report:
    """What was built: the published version and its figures, in the order of the lines."""

    version: str
    config_sha256: str
    inputs_sha256: str
    figures: dict[str, int] = field(default_factory=dict)

    def lines(self) -> list[str]:
        return [f"version={self.version}", f"config_sha256={self.config_sha256}", f"inputs_sha256={self.inputs_sha256}", *(f"{k}={v}" for k, v in self.figures.items())]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row."""
        fields = "version string, config_sha256 string, inputs_sha256 string, " + ", ".join(f"`{k}` long" for k in self.figures)
        return spark.createDataFrame([(self.version, self.config_sha256, self.inputs_sha256, *self.figures.values())], fields)


def canonical(value: object) -> str:
    """The one JSON text of a value: sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def inputs_hash(raw: DataFrame) -> str:
    """SHA-256 over the list of files, whatever their order: each one's kind, path, length and SHA-256.

    The list is cut into 4096 parts by a hash of kind and path; executors hash the parts, and the driver hashes their hashes in order.
    """
    part = F.pmod(F.xxhash64("kind", "input_path"), F.lit(4096))
    line = F.concat_ws("\t", "kind", "input_path", F.octet_length("bytes").cast("string"), F.sha2("bytes", 256))
    lists = raw.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h")).orderBy("part").collect()
    return hashlib.sha256("\n".join(f"{r['part']}:{r['h']}" for r in lists).encode()).hexdigest()


def _read(spark: SparkSession, branch: Branch, limits: Limits, stop: bool) -> tuple[DataFrame, DataFrame]:
    raw = None
    for kind, paths in (("txt", branch.txt), ("rss", branch.rss)):
        for p in paths:
            found = files.raw_files(spark, p, kind)
            raw = found if raw is None else raw.unionByName(found)
    if raw is None:
        raise EngineError("indexer.inputs", "a branch has no input")
    check_files(raw, limits)
    items = files.read_text(raw.where("kind = 'txt'")).unionByName(files.read_feeds(raw.where("kind = 'rss'")))
    items = admit_items(written(spark, items), limits)
    if not items.where("fault is not null").isEmpty():
        fault = items.where("fault is not null").orderBy("input_path", "record_ordinal").first()
        raise EngineError(fault["fault"], f"{fault['input_path']}, record {fault['record_ordinal']}")
    if stop and not items.where("status = 'failed'").isEmpty():
        raise EngineError("indexer.failed_input", "an input failed")
    return raw, items


def build_snapshot(
    spark: SparkSession, parent: str, version: str, search: Branch, recommendation: Branch | None = None, tokenizer: str = "english", distance: int | None = 3,
    limits: Limits | None = None, on_failure: str = "continue", exact: bool = True,
) -> tuple[Snapshot, Report]:
    """Reads both branches, drops near duplicates of the search branch, builds the index and the dictionary, and publishes them as a version.

    The recommendation branch (by default the same inputs) counts every document, duplicates included. ``distance`` None keeps all documents.
    ``on_failure`` 'stop' fails if any input fails, 'continue' leaves it out.
    """
    if on_failure not in ("stop", "continue"):
        raise EngineError("indexer.policy", "on_failure must be 'stop' or 'continue'")
    limits = limits or Limits()
    recommendation = recommendation or search
    raw, items = _read(spark, search, limits, on_failure == "stop")
    docs = written(spark, files.documents(items))
    figures = {f"search_{s}": 0 for s in ("success", "warning", "no_text", "rejected", "failed")}
    figures |= {f"search_{r['status']}": r["items"] for r in files.read_counts(items).collect()}
    tok = lambda d, words: terms.tokens(d, tokenizer, words, ("doc_id", "input_path", "record_ordinal"))
    if distance is not None:
        told = fingerprints.duplicates(tok(docs, search.stop_words).select("doc_id", "input_path", "record_ordinal", fingerprints.simhash_of("terms").alias("simhash")), distance)
        told = written(spark, told)
        counts = {r["disposition"]: r for r in fingerprints.decision_counts(told).collect()}
        for d in ("kept", "duplicate", "no_features"):
            figures[d] = counts[d]["documents"] if d in counts else 0
        figures["comparisons"] = sum(r["comparisons"] for r in counts.values())
        within(figures["comparisons"], limits.comparisons, "duplicate.comparisons")
        docs = written(spark, docs.join(told.where("disposition <> 'duplicate'").select("doc_id"), "doc_id", "left_semi"))
    check_terms(written(spark, terms.term_frequency(docs, tokenizer, search.stop_words)), limits)
    built = index.build_index(docs, tokenizer, search.stop_words, exact=exact)
    if recommendation == search:
        rec_raw, rec_items = raw, items
    else:
        rec_raw, rec_items = _read(spark, recommendation, limits, on_failure == "stop")
    rec_docs = files.documents(rec_items)
    rec_tf = written(spark, terms.term_frequency(rec_docs, tokenizer, recommendation.stop_words))
    check_terms(rec_tf, limits)
    words = written(spark, suggest.dictionary(terms.recommendation_frequency(rec_tf)))
    config = {"tokenizer": tokenizer, "distance": distance, "search": asdict(search), "recommendation": asdict(recommendation), "limits": asdict(limits), "on_failure": on_failure, "exact": exact}
    provenance = {"config_sha256": hashlib.sha256(canonical(config).encode()).hexdigest(), "inputs_sha256": hashlib.sha256((inputs_hash(raw) + inputs_hash(rec_raw)).encode()).hexdigest()}
    snap = publish(spark, parent, version, docs.select("doc_id", "title", "content", "url"), built, words, suggest.character_index(words), {"config": config, **provenance})
    stats = snap.manifest["statistics"]
    figures |= {f"search_{k}": stats[k] for k in ("documents", "terms", "postings", "total_tokens")} | {"recommendation_documents": rec_docs.count(), "recommendation_terms": stats["rec_terms"], "recommendation_tokens": stats["rec_tokens"], "character_links": stats["rec_chars"]}
    return snap, Report(version, figures=figures, **provenance)


def exit_code(error: EngineError) -> int:
    """The command's exit code for a failure."""
    if error.context.startswith(("indexer.", "config.", "limits.", "pipeline.")):
        return USAGE
    if error.context.startswith(("writer.", "storage.", "manifest.")):
        return WRITE
    return INPUT if error.context.startswith(("reader.path", "reader.duplicate_path", "item.status", "item.payload", "item.issues", "item.ordinal", "stopwords.")) else LIMIT


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Builds a version from the command line and prints its report as key=value lines."""
    parser = argparse.ArgumentParser(prog="python -m quillspark.indexer", exit_on_error=False)
    for name in ("--parent", "--version"):
        parser.add_argument(name, required=True)
    for branch in ("search", "recommendation"):
        for kind in ("txt", "rss"):
            parser.add_argument(f"--{branch}-{kind}", action="append", default=[])
        parser.add_argument(f"--{branch}-stop-words", help="a file with a word on each line")
    parser.add_argument("--tokenizer", default="english")
    parser.add_argument("--distance", type=int, default=3)
    parser.add_argument("--keep-duplicates", action="store_true")
    parser.add_argument("--on-failure", default="continue")
    parser.add_argument("--profile", choices=("none", "1"), default="none")
    try:
        got = parser.parse_args(args)
    except (argparse.ArgumentError, SystemExit) as e:
        print(f"error=config.argument\nmessage={e}", file=sys.stderr)
        return USAGE
    spark = spark or SparkSession.builder.appName("indexer").getOrCreate()

    def branch(name: str) -> Branch:
        path = getattr(got, f"{name}_stop_words")
        words = files.stop_words([r["value"] for r in spark.read.text(path).collect()]) if path else ()
        return Branch(tuple(getattr(got, f"{name}_txt")), tuple(getattr(got, f"{name}_rss")), tuple(sorted(words)))

    try:
        search, rec = branch("search"), branch("recommendation")
        _snap, report = build_snapshot(
            spark, got.parent, got.version, search, rec if rec.txt or rec.rss else None, got.tokenizer, None if got.keep_duplicates else got.distance,
            PROFILE_1 if got.profile == "1" else None, got.on_failure,
        )
    except EngineError as e:
        print(f"error={e.context}\nmessage={e.message}", file=sys.stderr)
        return exit_code(e)
    print("\n".join(report.lines()))
    return DONE


if __name__ == "__main__":
    sys.exit(main())
