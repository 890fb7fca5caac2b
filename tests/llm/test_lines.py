import random

import pytest
from test_outputs import DOCS, normal, plain_lines, shingle_set

from sitegrain.llm import line_dedup

NOTICE = "All rights reserved worldwide, unauthorised reproduction prohibited everywhere"


@pytest.mark.parametrize("line", [NOTICE, "Read more about this in our news", "x", "é" * 9 + "𝄞 tail of it", "12345", "123456"])
@pytest.mark.parametrize("size", [5, 9, 12])
def test_shingles_are_at_every_character(line, size):
    hashes, counts = line_dedup.shingles(["before", line, "", "after"], size)
    own = hashes[counts[0] : counts[0] + counts[1]].tolist()
    plain = [line[i : i + size] for i in range(max(len(line) - size + 1, 1))]
    assert len(own) == len(plain) and len(set(own)) == len(set(plain))
    assert [own.index(h) for h in own] == [plain.index(x) for x in plain]
    assert line_dedup.shingles([line], size)[0].tolist() == own


def test_signatures_do_not_depend_on_what_is_beside(monkeypatch):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefg hij") for _ in range(rng.choice([1, 8, 9, 60, 95, 130, 137, 138, 400, 3000]))) for _ in range(60)] + ["=" * 900, "ab " * 2000, "漢" * 5]
    whole = line_dedup.signatures(lines)
    assert (line_dedup.signatures(lines[::-1])[::-1] == whole).all()
    assert all((line_dedup.signatures([x])[0] == w).all() for x, w in zip(lines, whole))
    assert all(w.any() for w in whole)
    lines += [" ".join("phrase%d" % (i % 40) for i in range(900)), "漢字仮名" * 700]
    whole = line_dedup.signatures(lines)
    for size in (300, 500, 701):  # longer lines are hashed a part at a time
        monkeypatch.setattr(line_dedup, "SLICE", size)
        assert (line_dedup.signatures(lines) == whole).all()


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_forest_of_groups(similarity):
    rng = random.Random(int(similarity * 10))
    lines, groups = [], []
    for g in range(60):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 90)))
        for _ in range(rng.randint(1, 14)):
            lines.append(edits(rng, base, rng.randint(0, 6), "xyz"))
            groups.append(g)
    parent = list(range(len(lines)))

    def find(i, p):
        while p[i] != i:
            i = p[i]
        return i

    sets = [shingle_set(x) for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            if groups[i] == groups[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[find(i, parent)] = find(j, parent)
    forest = line_dedup.similar_forest(lines, line_dedup.np.array(groups), similarity)
    got = list(range(len(lines)))
    for i, j in forest:
        assert find(i, got) != find(j, got)
        got[find(i, got)] = find(j, got)
    same = lambda p: [[find(i, p) == find(j, p) for j in range(i)] for i in range(len(lines))]
    assert same(got) == same(parent)


RUN = "QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWKPBdGsx8u41cLq"


def test_variants_of_a_line(spark):
    variants = [
        (NOTICE, NOTICE[:-1] + "f"),
        ("In case of doubt, unauthorised use of this notice is prohibited", "In case of doubt, unauthorized use of this notice is prohibited"),
        ("Read more about this in our news", "Read more about this in our newz"),
        ("Click here to see all the comments", "Click here to see all the comments."),
        ("版权所有未经书面许可不得以任何形式转载复制本网站的内容。", "版权所有未经书面许可不得以任何形式转载复制本网站的内容！"),
        ("https://example.org/a/b?id=1234", "https://example.org/a/b?id=1235"),
        ("name\tstreet\ttown\tpostcode\tcountry\ttelephone\tcustomer\tbalances", "name\tstreet\ttown\tpostcode\tcountry\ttelephone\tcustomer\tbalance"),
        ("Tous\u00a0droits\u00a0réservés\u00a0partout", "Tous\u00a0droits\u00a0réservés\u00a0partout."),
        (RUN, "x" + RUN),
        ("=" * 300, "=" * 80),
        ("ab " * 400, "ab " * 30 + "a"),
        ("spam and eggs for the crew!! " * 90, "spam and eggs for the crew!! " * 60),
    ]
    frame = spark.createDataFrame([(i, "\n".join(pair)) for i, pair in enumerate(variants)], "doc_id long, text string")
    assert sorted(line_dedup.deduplicated_lines(frame).collect()) == [(i, 2, 1, "1") for i in range(len(variants))]


def edits(rng, line, n, letters):
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        line = line[:at] + rng.choice(["", rng.choice(letters)]) + line[at + rng.randrange(2) :]
    return line


def kinds(rng):
    """(kind, letters, line) for every kind of line."""
    english = "abcdefghijklmnoprstuvwy"
    han = [chr(0x4E00 + k) for k in range(2000)]
    word = lambda: "".join(rng.choice(english) for _ in range(rng.randint(1, 9)))
    yield "english", english, " ".join(word() for _ in range(rng.randint(4, 40)))
    yield "long english", english, " ".join(word() for _ in range(rng.randint(150, 400)))
    yield "han", han, "".join(rng.choice(han) for _ in range(rng.randint(12, 200)))
    yield "tabs", english, "\t".join(word() for _ in range(rng.randint(4, 40)))
    yield "address", english, "https://" + "/".join(word() for _ in range(rng.randint(4, 20)))


def test_recall_against_all_pairs(spark):
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 1500:
        for kind, letters, line in kinds(rng):
            other = edits(rng, line, rng.randint(1, max(1, len(line) // 40)), letters)
            a, b = shingle_set(normal(line)), shingle_set(normal(other))
            if normal(line) != normal(other) and len(a & b) >= 0.8 * len(a | b):
                pairs.append((len(pairs), kind, line + "\n" + other))
    frame = spark.createDataFrame([(i, text) for i, _, text in pairs], "doc_id long, text string")
    judged = {r.doc_id: r.n_kept for r in line_dedup.deduplicated_lines(frame).collect()}
    for kind in {k for _, k, _ in pairs}:
        found = [judged[i] == 1 for i, k, _ in pairs if k == kind]
        assert len(found) >= 200 and sum(found) >= 0.95 * len(found), kind


def test_links_are_exact(spark):
    """What is linked is what a plain comparison of all pairs links."""
    rng = random.Random(3)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 25))) for _ in range(15)]
    lines = base + [edits(rng, b, n, "z") for b in base for n in (1, 1, 2, 3)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))), "s", "") for i in range(40)]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.dropped) for r in line_dedup.deduplicated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_lines(rows)


@pytest.mark.parametrize("limit", [2048, 16])
def test_family_around_a_missing_base(spark, limit, monkeypatch):
    """Many lines that are near each other, most of them not near enough: none of the joining links is lost."""
    monkeypatch.setattr(line_dedup, "GROUP_LIMIT", limit)
    rng = random.Random(5)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(30))
    lines = [edits(rng, base, rng.randint(2, 9), "xyz") for _ in range(90)]
    rows = [(i, line, "", "") for i, line in enumerate(lines)]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.dropped) for r in line_dedup.deduplicated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_lines(rows)


def test_lines_fold_case_and_blanks(spark):
    lines = ["SHARE THIS ARTICLE ON FACEBOOK AND TWITTER NOW", "Share this article on Facebook and Twitter now", "Short", "short ", "x", "\tX", "a\tb", "A b", "ÉTÉ", "été", "\t \r", "other"]
    rows = [(1, "\n".join(lines), "", ""), (2, "\n".join(reversed(lines)), "", "")]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.dropped) for r in line_dedup.deduplicated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_lines(rows) and got[1][1] == 6


def few_kinds(rng):
    """(kind, letters, line) for lines of few symbols or words."""
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    yield "bits", "01", some("01", rng.randint(60, 300))
    yield "four letters", "acgt", some("acgt", rng.randint(200, 5000))
    words = [some("abcdefghijklmnop", rng.randint(3, 8)) for _ in range(4)]
    yield "four words", "abc ", " ".join(rng.choice(words) for _ in range(rng.randint(12, 60)))
    yield "digits", "0123456789 ", some("0123456789 ", rng.randint(3000, 9000))


def test_recall_on_lines_of_few_symbols(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(120):
        for kind, letters, line in few_kinds(rng):
            for n in (1, max(1, len(line) // 60)):
                other = edits(rng, line, n, letters)
                a, b = shingle_set(normal(line)), shingle_set(normal(other))
                if normal(line) != normal(other) and len(a & b) >= 0.8 * len(a | b):
                    pairs.append((kind, line, other))
    signed = line_dedup.signatures([x for _, a, b in pairs for x in (normal(a), normal(b))])
    for kind in {k for k, *_ in pairs}:
        found = [((signed[2 * i] == signed[2 * i + 1]) & (signed[2 * i] != 0)).any() for i, (k, *_) in enumerate(pairs) if k == kind]
        assert len(found) >= 50 and sum(found) >= 0.95 * len(found), (kind, sum(found), len(found))


def test_a_large_group_makes_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_LIMIT", 50)
    rng = random.Random(6)
    lead = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    lines = [lead, *(lead[:50] + f"{n:04d}" + lead[54:] for n in range(3000)), *("x" * 40 + str(n) + lead[:40] for n in range(20))]
    members = spark.createDataFrame([(7, 7 if n == 0 else n + 100, n, x) for n, x in enumerate(lines)], "lead long, k long, id long, line string")
    met = line_dedup.meet_lead(members)
    flags = {r.id: r.linked for r in met.collect()}
    sets = [shingle_set(x) for x in lines]
    assert flags == {n: len(s & sets[0]) >= 0.8 * len(s | sets[0]) for n, s in enumerate(sets)} and sum(flags.values()) == 3001
    parts = line_dedup.meet_rest(met).collect()
    assert len(parts) <= 3001 + 20 * 80
    together = {}
    for r in parts:
        together.setdefault(r.part, set()).add(r.id)
    for n in range(3001, 3021):
        assert set().union(*(g for g in together.values() if n in g)) == set(range(3021))
    assert line_dedup.meet_rest(met.filter("linked")).count() == 0
