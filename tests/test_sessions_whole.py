"""Sessions remember every idempotency key."""

from pathwise.streaming import sessions


def test_a_key_is_known_after_many_others(spark):
    event = lambda kind, key, revision, entry, day: ("s", kind, key, revision, entry, 1 if entry else None, day, "")
    first = event("entry", "k", 0, "e", "2024-01-01")
    edits = [event("edit", f"x{k}", None, "e", "2024-01-01") for k in range(1500)]
    again = [first, edits[0], event("edit", "k", None, "e", "2024-01-02")]
    rows = [(*row, k) for k, row in enumerate([first, *edits, *again])]
    got = sessions.replay(spark.createDataFrame(rows, sessions.EVENT)).orderBy("seq").collect()
    assert [r["outcome"] for r in got[-3:]] == ["replayed", "replayed", "conflict"]
    assert got[-1]["revision"] == 1501
