import datetime as dt

import pytest

from tracewell.sources import daily

DAY = dt.date(2024, 3, 1)


class Killed(Exception):
    pass


def write(path, rows, bad=0):
    lines = [f"t{i},{s},{d},{a},2024-03-01 10:00:{i % 60:02d},x" for i, (s, d, a) in enumerate(rows)] + [f"b{i},A,B,nothing,2024-03-01 10:00:00,x" for i in range(bad)]
    path.write_text("\n".join(["txn_id,src,dst,amount,ts,channel", *lines]) + "\n")
    return str(path)


@pytest.mark.parametrize("step", daily.STEPS)
def test_a_load_that_is_killed_is_there_once_after_it_is_repeated(spark, tmp_path, step):
    store = daily.DailyStore(spark, str(tmp_path / "store"))
    first = write(tmp_path / "a.csv", [("A", "B", 5), ("B", "C", 6)])
    assert store.load(first, DAY) == "SUCCESS"
    second = write(tmp_path / "b.csv", [("A", "D", 7), ("E", "D", 8), ("E", "A", 9)])

    def kill(name):
        if name == step:
            raise Killed

    with pytest.raises(Killed):
        store.load(second, DAY, after=kill)
    seen = store.ledger().count()
    assert seen == (5 if step in ("published", "marked") else 2)  # all of a load or nothing
    assert store.load(second, DAY) == ("SKIPPED" if step == "marked" else "SUCCESS")
    assert store.load(second, DAY + dt.timedelta(days=1)) == "SKIPPED"
    assert sorted(r.amount for r in store.ledger().collect()) == [5.0, 6.0, 7.0, 8.0, 9.0]
    assert sorted(r.account for r in store.accounts().collect()) == ["A", "B", "C", "D", "E"]
    last = store.manifest().where("transfers = 3").collect()
    assert [(r.status, r.new_accounts, r.known_accounts, r.day) for r in last] == [("SUCCESS", 2, 1, DAY)]


def test_bad_and_repeated_files(spark, tmp_path):
    store = daily.DailyStore(spark, str(tmp_path / "store"))
    rows = [("A", "B", 5 + i) for i in range(300)]
    assert store.load(write(tmp_path / "a.csv", rows, bad=1), DAY) == "SUCCESS"
    assert store.load(write(tmp_path / "b.csv", rows, bad=9), DAY) == "FAILED"
    assert store.load(write(tmp_path / "c.csv", []), DAY) == "FAILED"
    assert {(r.status, r.why) for r in store.manifest().collect()} == {("SUCCESS", ""), ("FAILED", "null_amount"), ("FAILED", "no rows")}
    # the same lines in another order and file are the same content
    lines = (tmp_path / "a.csv").read_text().splitlines()
    (tmp_path / "d.csv").write_text("\n".join([lines[0], *reversed(lines[1:])]) + "\n")
    assert store.load(str(tmp_path / "d.csv"), DAY) == "SKIPPED"
    assert store.load(str(tmp_path / "a.csv"), DAY + dt.timedelta(days=2), force=True) == "SUCCESS"
    assert store.ledger().count() == 301 and {r.day for r in store.ledger().select("day").distinct().collect()} == {DAY + dt.timedelta(days=2)}
