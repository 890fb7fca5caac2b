import random
import zlib

import pytest

from sitegrain.llm import replay

LOG = "lsn long, stream string, op string, key long, value long"


def plain(log, epoch_commits):
    """The log read record by record."""
    out, store, commits, open_ = [], {}, 0, {}

    def state():
        live = {k: v for k, v in store.items() if v is not None}
        out.append(("state", -(-commits // epoch_commits), len(live), sum(live.values())))

    for lsn, stream, op, key, value in sorted((r for r in log if r[0] is not None), key=lambda r: r[0]):
        done = open_.setdefault(stream, [])  # changes and "savepoint" marks that remain
        if op == "change":
            done.append((lsn, key, value))
        elif op == "savepoint":
            done.append(None)
        elif op == "rollback":
            while done and (top := done.pop()) is not None:
                out.append(("rollback", top[0], lsn, top[1]))
        else:
            for change in filter(None, open_.pop(stream)):
                if op == "commit":
                    store[change[1]] = change[2]
                else:
                    out.append(("abort", change[0], lsn, change[1]))
            if op == "commit":
                commits += 1
                if commits % epoch_commits == 0:
                    state()
    if commits % epoch_commits:
        state()
    out += [("abort", c[0], None, c[1]) for done in open_.values() for c in filter(None, done)]
    return sorted(out, key=repr)


def rows(spark, log, epoch_commits):
    frame = spark.createDataFrame(log, LOG).repartition(5)
    return sorted((tuple(r) for r in replay.reassemble(frame, epoch_commits).collect()), key=repr)


@pytest.mark.parametrize("seed,weights", [(1, (2, 1, 3, 3, 9)), (2, (0, 0, 5, 5, 9)), (3, (1, 1, 30, 5, 9)), (4, (1, 1, 5, 30, 9))])
def test_random_logs(spark, seed, weights):
    rng = random.Random(seed)
    ops = rng.choices(("commit", "abort", "savepoint", "rollback", "change"), weights, k=900)
    log = [(n * 3, rng.choice((None, "", "a", "a", "a", "b")), op, rng.randrange(12) if op == "change" else None, rng.choice((None, rng.randrange(99))) if op == "change" else None) for n, op in enumerate(ops)]
    assert rows(spark, log, 4) == plain(log, 4)


def test_one_deep_transaction(spark):
    log = [(n, "s", "savepoint" if n % 2 else "change", 7, n) for n in range(200)] + [(200 + n, "s", "rollback", None, None) for n in range(150)] + [(350, "s", "change", 1, 5), (351, "s", "commit", None, None)]
    assert rows(spark, log, 64) == plain(log, 64)


def test_logs_without_commits_and_without_records(spark):
    log = [(1, None, "rollback", None, None), (2, None, "change", 5, 1), (None, "x", "change", 5, 1)]
    assert rows(spark, log, 64) == [("abort", 2, None, 5)]
    assert rows(spark, [], 64) == []


def test_repeated_records(spark):
    log = [(1, "s", "change", 5, 1), (1, "s", "change", 5, 1), (2, "s", "savepoint", None, None), (2, "s", "savepoint", None, None), (3, "s", "change", 6, 1), (4, "s", "rollback", None, None), (5, "s", "commit", None, None), (5, "s", "commit", None, None)]
    assert rows(spark, log, 1) == sorted([("rollback", 3, 4, 6), ("state", 1, 1, 1), ("state", 2, 1, 1)], key=repr)


def test_records_of_documents(spark):
    docs = [(n, f"text {n % 7}" if n % 5 else None, ("a", None)[n % 2], "more") for n in range(300)] + [(None, "x", "a", "more"), (None, None, None, None)]
    labels = [(n, 1) for n in range(0, 300, 11)] + [(11, 0), (None, 1), (12, None)]
    found = replay.log_records(spark.createDataFrame(docs, "doc_id long, text string, source string, lsn string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    expected = []
    for n, text, source, _ in docs[:300]:
        h = zlib.crc32(str(n).encode())
        op = ["commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback", *["change"] * 10][h % 17]
        key = h // 100 % 30000 if op == "change" else None
        value = zlib.crc32(f"{key}:{text}".encode()) if op == "change" and text is not None and n % 11 else None
        expected.append((n, source, op, key, value))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert rows(spark, expected, 64) == plain(expected, 64)
