"""Tables of metric lines, as the reference's parser writes them."""

from strandline.functions import logs

LINES = [
    "x [WINDOW RESULT] windowStart=0 windowEnd=5000 count=3 processingTime=7",
    "[SPATIAL INDEX] action=insert cell=(1,2) size=4 objectId=a lat=59.9 lon=-30.1",
    "[COLLISION] pair=(a,b) distance=1.5 now ttc=2.0 relativeSpeed=3.5",
    "[COLLISION] detected pair=(a,c) distance=2.5 ttc=1.0",
    "[COLLISION] summary events=4 pairs=6 collisions=2 timeMs=1.25",
    "[CONFLICT] skipZeroSpeed pair=(a,b) t=0.5 distance=9.0",
    "[DENSITY] global count=5 totalAreaKm2=2.5 density=2.0",
    "[KNN] action=findKNN k=3 candidates=9 distanceComputations=9 returned=3 timeMs=0.1 queryLat=-1.5 queryLon=2.5",
    "[DENSITY] global count=1 totalAreaKm2=1 density=1 [KNN] action=findKNN k=1 candidates=1 distanceComputations=1 returned=1 timeMs=1 queryLat=1 queryLon=1",
    "[SWARM] seed=a neighbors=4",
    "[SWARM] seed=b neighbors=4",
    "[SWARM] seed=a neighbors=5",
    "[SWARM] expand current=a neighbors=3",
    "[SWARM] expand current=a neighbors=2",
    "nothing",
]


def test_tables(spark):
    name = "/x/realtime_burst_swarm_city_20260102_030405.log"
    lines = spark.createDataFrame([(name, x) for x in LINES], "file string, line string")
    table = lambda name: sorted(tuple(r)[:-1] for r in logs.metric_table(lines, name).collect())
    assert table("window") == [("0", "5000", "3", "7")]
    assert table("spatial_insert") == [("1", "2", "4", "a", "59.9", "-30.1")]
    assert table("collision_pair") == [("a", "b", "1.5", "2.0", "3.5"), ("a", "c", "2.5", "1.0", "")]
    assert table("collision") == [("4", "2", "1.25")] and table("conflict_pair") == [("skipZeroSpeed", "a", "b", "0.5", "9.0")]
    assert len(table("density")) == 2 and len(table("knn")) == 1 and table("timestamp") == []
    assert {r.object_id: r["size"] for r in logs.swarm_sizes(lines).collect()} == {"a": 3, "b": 1}
    assert [(str(r["at"]), r.n) for r in logs.swarm_growth(lines).collect()] == [("2026-01-02 03:04:05", 2)]
