"""Job/stage profile of one registered query from Spark's event log
(written to a fresh scratch folder; no UI, no server).

    python tests/jobprofile.py rank_state /root/testdata/sf0.1
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(log_dir: str):
    for path in sorted(glob.glob(os.path.join(log_dir, "*", "events_*")) +
                       glob.glob(os.path.join(log_dir, "*", "*.zstd"))):
        raw = open(path, "rb")
        if path.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(raw)
        for line in io.TextIOWrapper(raw, encoding="utf-8"):
            yield json.loads(line)


def main(name: str, src: str) -> None:
    scratch = tempfile.mkdtemp(prefix="tractus-profile-")
    from tractus.session import get_session
    spark = get_session("local[8]", 8, extra={"spark.eventLog.enabled": "true",
                                             "spark.eventLog.dir": scratch})
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    import __spark_entry__ as E
    q = E.queries()[name]
    q(spark, src).write.format("noop").mode("overwrite").save()          # warm-up
    t0 = time.time()
    q(spark, src).write.format("noop").mode("overwrite").save()
    wall = time.time() - t0
    spark.stop()
    jobs, stages = {}, {}
    for e in _events(scratch):
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, e.get("Stage IDs", [])]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Number of Tasks"],
                                      si.get("Completion Time", 0) - si.get("Submission Time", 0))
    timed = sorted(jobs.items())[len(jobs) // 2:]
    start = timed[0][1][0] if timed else 0
    print(f"{name}: warm run {wall:.2f}s, {len(timed)} jobs")
    for jid, (s, c, sids) in timed:
        detail = ", ".join(f"stage {sid}: {stages[sid][0]} tasks {stages[sid][1]} ms"
                           for sid in sids if sid in stages)
        print(f"  job {jid:4d} at +{s - start:5d} ms, {c - s:5d} ms  [{detail}]")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1")
