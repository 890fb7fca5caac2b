import hashlib
import random
import re

from sitegrain.llm import decontaminate, exact_dedup

DOCS = "doc_id long, text string"


def sha(x):
    return hashlib.sha256((x or "").encode()).hexdigest()


def test_exact_duplicates(spark):
    rng = random.Random(1)
    long = ["".join(rng.choice("abc .\né") for _ in range(n)) for n in (10, 600, 5000, 20000)]
    texts = long + [t[:-1] for t in long] + long + ["", None, "A", "a", "a"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        same = [j for j, o in rows if (o or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), sha(t))


def test_chunks_join_to_the_text_and_resynchronise(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) + rng.choice(["", "", "."]) for _ in range(3000))
    rows = spark.createDataFrame([(0, text), (1, "Inserted words. " + text), (2, "x" * 9000)], DOCS)
    parts = {r[0]: r[1] for r in rows.select("doc_id", exact_dedup.chunks(rows.text)).collect()}
    assert "".join(parts[0]) == text and "".join(parts[2]) == "x" * 9000
    assert len(set(parts[0]) & set(parts[1])) > 0.8 * len(parts[0])


def test_exact_duplicates_edges(spark):
    rows = [(5, "same", "q"), (5, "same", "r"), (None, "same", "s"), (None, "alone", None)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, keep_id string")).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(5, 5, 3), (None, 5, 3), (None, None, 1)}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def plain(docs, bench, window=13):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2f:-`{-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]

    out = {}
    for i, t in docs:
        d, hit, found = words(t), set(), set()
        for item, bt in bench:
            b = words(bt)
            if not b:
                continue
            k = min(window, len(b))
            windows = {tuple(b[s : s + k]) for s in range(len(b) - k + 1)}
            for s in range(len(d) - k + 1):
                if tuple(d[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    found.add(item)
        out[i] = (len(d), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(d))
    return out


def check(spark, docs, bench):
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == plain(docs, bench)


def test_contamination(spark):
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(30)] + ["Éa", "the", "THE", "a-b"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(rng.randint(13, 40))) for i in range(12)] + [(99, None), (98, "..."), (97, "the " * 30)]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(bench)[1] or ""
            words = b.split()
            a = rng.randint(0, max(0, len(words) - 1))
            t += " " + ", ".join(words[a : a + rng.randint(8, 30)]).upper() + " " + text(rng.randint(0, 50))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "the " * 50), (103, bench[0][1])]
    check(spark, docs, bench)
    check(spark, docs, [*bench, (50, "w1 w2 w3 w4 w5 w6 w7"), (51, "w3"), (52, "w4 w5")])


def test_contamination_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], DOCS)
    assert [tuple(r[1:4]) for r in decontaminate.contamination(docs, empty).orderBy("doc_id").collect()] == [(0, 0, 0), (2, 0, 0), (2, 0, 0)]
    bench = spark.createDataFrame([(3, "A b!", "x")], "item_id long, text string, key string")
    assert decontaminate.drop_contaminated(docs, bench).count() == 1
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), bench).count() == 0
