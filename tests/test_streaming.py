"""Arriving candidates through a file stream: verdicts stay, ids go on, untouched projects are kept."""

from fleetcut.streaming.arrivals import CUT_COLUMNS, bucket_of, latest_cuts, on_arrival, refresh_cuts, seed_cuts

CUT = "project_id long, cut_id string, start_ms long, end_ms long, reason string, confidence double, status string, note string"
CAND = "project_id long, ord long, start_ms long, end_ms long, reason string, confidence double, status string, note string"


def test_candidates_arrive(spark, tmp_path):
    cuts, inbox = str(tmp_path / "cuts"), str(tmp_path / "inbox")
    first = [(1, "c0001", 0, 1000, "silence", 0.5, "rejected", "kept"), (2, "c0007", 0, 1000, "silence", 0.5, "proposed", None)]
    seed_cuts(spark.createDataFrame(first, CUT), cuts)
    untouched = spark.createDataFrame([(2,)], "project_id long").select(bucket_of()).first()[0]
    for k, rows in enumerate(([(1, 0, 50, 1000, "silence", 0.9, "approved", None), (1, 1, 5000, 6000, "silence", 0.9, "approved", None)], [(1, 0, 5000, 6100, "silence", 0.8, "approved", None)])):
        spark.createDataFrame(rows, CAND).coalesce(1).write.mode("append").parquet(inbox)
        on_arrival(spark.readStream.schema(CAND).parquet(inbox), refresh_cuts(cuts), str(tmp_path / "state")).awaitTermination(120)
        got = {(r.project_id, r.cut_id): (r.start_ms, r.end_ms, r.status) for r in latest_cuts(spark.read.parquet(cuts)).collect()}
        assert latest_cuts(spark.read.parquet(cuts)).columns == list(CUT_COLUMNS)
        assert got[2, "c0007"] == (0, 1000, "proposed")
        if k == 0:
            assert got[1, "c0001"] == (50, 1000, "rejected") and got[1, "c0002"] == (5000, 6000, "approved")
        else:
            assert [p.name for p in (tmp_path / "cuts" / f"bucket={untouched}").iterdir()] == ["version=0"]
            assert got == {(1, "c0001"): (50, 1000, "rejected"), (1, "c0002"): (5000, 6100, "approved"), (2, "c0007"): (0, 1000, "proposed")}
