"""Command line: queries, masks, scores, the combination search, loop detection."""

from __future__ import annotations

import argparse
import logging
import signal
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("velatura")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="velatura", description=__doc__)
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    p.add_argument("--master", help="where to run; the session's own by default")
    sub = p.add_subparsers(dest="what", required=True)
    one = sub.add_parser("query", help="run a query of the catalogue")
    one.add_argument("name")
    one.add_argument("data")
    one.add_argument("--out", help="Parquet folder; shown by default")
    mask = sub.add_parser("mask", help="tag and mask a record dataset with a session's knowledge")
    mask.add_argument("records")
    mask.add_argument("knowledge")
    mask.add_argument("out")
    mask.add_argument("--session", type=int, required=True)
    mask.add_argument("--from", dest="start", type=int, default=0, help="first record")
    mask.add_argument("--to", dest="end", type=int, help="record to stop before")
    score = sub.add_parser("score", help="score masked, labelled records")
    score.add_argument("records", help="Parquet with id, text, labels, mascara")
    score.add_argument("out")
    score.add_argument("--chars", default="*#", help="the two mask characters")
    search = sub.add_parser("search", help="search the combinations of sessions")
    search.add_argument("records", help="Parquet with rec_idx, texto, labels")
    search.add_argument("knowledge")
    search.add_argument("out")
    search.add_argument("--sessions", required=True, help="ids, by commas or blanks")
    search.add_argument("--mode", default="uniao", choices=["uniao", "interseccao"])
    loops = sub.add_parser("loops", help="find repetition loops in texts")
    loops.add_argument("texts", help="Parquet with id and a text column")
    loops.add_argument("out")
    loops.add_argument("--column", default="raciocinio")
    loops.add_argument("--detectors", default="1,2,3,4")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level, format="%(asctime)s %(levelname)s %(message)s")
    if spark is None:
        build = SparkSession.builder.appName("velatura")
        spark = (build.master(a.master) if a.master else build).getOrCreate()
        signal.signal(signal.SIGTERM, lambda *_: _stop(spark))
    from velatura.config import LoopSettings
    from velatura.operators import lattice
    from velatura.plans import catalogue, pipeline
    from velatura.sources import readers, sinks
    from velatura.streaming import loops

    read = spark.read.parquet
    if a.what == "query":
        out = catalogue.QUERIES[a.name](spark, a.data)
        out.write.mode("overwrite").parquet(a.out) if a.out else out.show(50, truncate=80)
    elif a.what == "mask":
        rows = readers.read_records(spark, a.records)
        rows = rows.where((F.col("rec_idx") >= a.start) & (F.col("rec_idx") < (a.end if a.end is not None else 1 << 62)))
        pipeline.run(rows, read(a.knowledge).where(F.col("sessao_id") == a.session), a.session)[0].write.mode("overwrite").parquet(a.out)
    elif a.what == "score":
        if sinks.write_scores(read(a.records), a.out, (a.chars[0], a.chars[1])) is None:
            log.warning("no record to score")
    elif a.what == "search":
        lattice.search(read(a.records), read(a.knowledge), lattice.parse_ids(a.sessions), a.mode).write.mode("overwrite").parquet(a.out)
    elif a.what == "loops":
        settings = LoopSettings(active=frozenset(lattice.parse_ids(a.detectors)))
        loops.detect_texts(read(a.texts), "id", a.column, settings).write.mode("overwrite").parquet(a.out)
    log.info("%s is done", a.what)
    return 0


def _stop(spark: SparkSession) -> None:
    """End the jobs that run; nothing half written is published."""
    spark.sparkContext.cancelAllJobs()
    sys.exit(0)


if __name__ == "__main__":
    sys.exit(main())
