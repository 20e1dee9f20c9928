"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`baseline` holds our own single-process numpy times of the same results, reading included; the
project that this engine follows publishes none.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pyarrow.parquet as pq

from statelens.plans.queries import queries
from statelens.session import build_session

NAMES = ("layer_efficiency", "network_efficiency", "histogram", "spatial_states_nchw", "per_class_histogram", "wide_pack_efficiency", "bench_lineitem_states")


def numpy_lineitem(d: str) -> dict:
    t = pq.read_table(f"{d}/lineitem.parquet", columns=["l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    x = np.stack([t[c].to_numpy() - m for c, m in (("l_quantity", 25.0), ("l_discount", 0.05), ("l_tax", 0.04), ("l_extendedprice", 30000.0))], axis=1)
    key, flag = np.packbits(x > 0, axis=1, bitorder="little")[:, 0], t["l_returnflag"].to_numpy(zero_copy_only=False)
    out = {}
    for f in np.unique(flag):
        p = np.unique(key[flag == f], return_counts=True)[1] / (flag == f).sum()
        out[f] = float(-(p * np.log2(p)).sum() / 4)
    return out


def numpy_wide(d: str) -> float:
    t = pq.read_table(f"{d}/embeddings.parquet", columns=["embedding"])
    x = t["embedding"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    c = np.unique(np.packbits(x > 0, axis=1, bitorder="little"), axis=0, return_counts=True)[1] / t.num_rows
    return float(-(c * np.log2(c)).sum() / x.shape[1])


def best(f, n: int = 3) -> float:
    took = []
    for _ in range(n):
        at = time.perf_counter()
        f()
        took.append(time.perf_counter() - at)
    return round(min(took), 3)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    found = {}
    for name in NAMES:
        found[name] = best(lambda name=name: queries()[name](spark, d).write.format("noop").mode("overwrite").save())
    spark.stop()
    base = {"bench_lineitem_states": best(lambda: numpy_lineitem(d)), "wide_pack_efficiency": best(lambda: numpy_wide(d))}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "baseline": base, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
