"""Array records, granules and archives with passing defaults."""

import json

from stratagrid.plans import assessment
from stratagrid.sources import records


def pvar(name, **more):
    return {"name": name, "shape": [10, 20], "chunks": [5, 20], "dtype": "float32", "codecs": ["BytesCodec", "Zlib"], "dims": ["y", "x"], "cf": {}, "grid": {}, "n_chunks": 4, "chunk_bytes_median": 1000000, "overview": False} | more


def probe(*arrays, **more):
    return {"vars": list(arrays), "ok": True, "attempted": True, "error_type": "", "error": "", "root_attrs": {}, "url": "https://example.test/g.nc"} | more


def refusal(kind, message, **more):
    return probe(ok=False, error_type=kind, error=message, **more)


def documents(spark, archives, level="L3"):
    """archives: {collection: [probe, ...]}; a pair (level, [probe, ...]) sets the level."""
    rows = []
    for name, probes in archives.items():
        at, probes = probes if isinstance(probes, tuple) else (level, probes)
        rows.append(json.dumps({"short_name": name, "level": at, "probes": probes}))
    return spark.read.schema(records.PROBES).json(spark.sparkContext.parallelize(rows, 2))


def archive(spark, archives, level="L3"):
    return assessment.archive_of(documents(spark, archives, level))


def statuses(df):
    return {r.collection_id: r.status for r in df.collect()}


def notes(df):
    return {r.collection_id: r.note for r in df.collect()}
