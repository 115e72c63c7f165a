"""Incremental scans of a stream of file versions: what each version adds, keeps and fixes, from state kept by path.

A version (path, at, version, content) is scanned once, in a map over whole files. Its findings then meet the last version's in
state keyed by path (RocksDB): fingerprints in both are unchanged, only in the new one new, only in the old one fixed. The
state of a path is one row, bounded by the findings of a file.

Defined results: versions of a path count in the order of (at, version), within a batch and across batches; one that is not
after the last one of its path gives nothing, so repeats and late versions don't undo newer ones; versions older than the watermark are
dropped; null content is a deleted file, all of whose findings are fixed and whose state goes; files of unknown language have no findings; rows
without path, at or version are left out.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glintsieve.functions import text as T
from glintsieve.operators import analyze
from glintsieve.plans import scan
from glintsieve.sources import languages

LATE = "1 hour"
DELTAS = "path string, at timestamp, version long, rule_id string, line int, fingerprint string, state string"
_FOUND = pa.struct([("line", pa.int32()), ("rule_id", pa.string()), ("text", pa.string()), ("comments", pa.string()), ("ordinal", pa.int32())])


def version_findings(versions: DataFrame, settings: scan.Settings | None = None) -> DataFrame:
    """path, at, version, whether the file is there, and its findings (fingerprint, rule_id, line), one row a version."""
    settings = settings or scan.Settings()
    between = settings.between_functions
    known = versions.filter("path is not null and at is not null and version is not null").select("path", "at", "version", languages.language(F.col("path")).alias("language"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, language, content in zip(*(batch.column(c) for c in ("path", "language", "content"))):
                seen: Counter = Counter()
                rows = []
                for _, _, line, text, _, comments, _, _, _, rule_id, _ in analyze.matches_of(path.as_py(), language.as_py(), content.as_py(), between):
                    rows.append({"line": line, "rule_id": rule_id, "text": text, "comments": comments, "ordinal": seen[rule_id, text]})
                    seen[rule_id, text] += 1
                found.append(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "at", "version")), batch.column("content").is_valid(), pa.array(found, pa.list_(_FOUND))], ["path", "at", "version", "there", "found"])

    rows = known.mapInArrow(run, "path string, at timestamp, version long, there boolean, found array<struct<line:int,rule_id:string,text:string,comments:string,ordinal:int>>")
    kept = F.filter("found", lambda x: scan.rule_enabled(x["rule_id"], F.col("path"), settings) & ~T.suppressed(x["comments"], x["rule_id"], settings.keyword))
    shown = F.transform(kept, lambda x: F.struct(T.fingerprint(x["rule_id"], F.col("path"), x["text"], x["ordinal"]).alias("fingerprint"), x["rule_id"].alias("rule_id"), x["line"].alias("line")))
    return rows.select("path", "at", "version", "there", F.to_json(shown).alias("findings"))


class Compared(StatefulProcessor):
    """Compares each version of a path with the one before, which the state holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, version long, findings string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        order, known = (tuple(held[:2]), json.loads(held[2])) if held else ((-(1 << 63), 0), [])
        out, there = [], held is not None
        for at, version, exists, findings in sorted((r.at, r.version, r.there, r.findings) for frame in rows for r in frame.itertuples()):
            place = (at.value, int(version))
            if place <= order:
                continue
            new = json.loads(findings) if exists else []
            old = {x["fingerprint"] for x in known}
            out += [(at, version, x, "unchanged" if x["fingerprint"] in old else "new") for x in new]
            left = old - {x["fingerprint"] for x in new}
            out += [(at, version, x, "fixed") for x in known if x["fingerprint"] in left]
            order, known, there = place, new, exists
        # a deleted file keeps its place in the order alone
        self.last.update((*order, json.dumps(known if there else [])))
        frame = pd.DataFrame([(key[0], at, int(version), x["rule_id"], x["line"], x["fingerprint"], state) for at, version, x, state in out], columns=["path", "at", "version", "rule_id", "line", "fingerprint", "state"])
        yield frame.astype({"version": "int64", "line": "int32", "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def deltas(versions: DataFrame, settings: scan.Settings | None = None, late: str = LATE) -> DataFrame:
    """The findings of a stream of versions with their states: new, unchanged or fixed."""
    rows = version_findings(versions, settings).withWatermark("at", late)
    return rows.groupBy("path").transformWithStateInPandas(statefulProcessor=Compared(), outputStructType=DELTAS, outputMode="Append", timeMode="EventTime")


def run(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has come until now as Parquet and ends; the next run with the same checkpoint goes on from there."""
    conf, name = changes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def written(spark: SparkSession, path: str) -> DataFrame:
    """The deltas that runs have written."""
    return spark.read.schema(DELTAS).parquet(path)
