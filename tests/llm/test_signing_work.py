import random

from sitegrain.llm import line_dedup


def test_few_words_also_where_the_middle_cuts_one():
    rng = random.Random(5)
    words = ["ab", "abc", "xxxxxxxxxxxx"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(7, 9))) for _ in range(400)]
    few = [line for line in lines if len(line) >= line_dedup.FEW_LEAST and len(set(line.split(" "))) <= line_dedup.FEW_WORDS * (line.count(" ") + 1)]
    alike = [line for line in few if len({line[i : i + 5] for i in range(len(line) - 4)}) < line_dedup.FEW_SHARE * (len(line) - 4)]
    assert len(alike) > 20 and (line_dedup.signatures(alike)[:, 2 * line_dedup.BANDS :] != 0).all()


def test_long_lines_mix_only_what_may_be_least(monkeypatch):
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000)) for _ in range(50)]
    mixed, seen = line_dedup._mixed, []
    monkeypatch.setattr(line_dedup, "_mixed", lambda h: seen.append(h.size) or mixed(h))
    assert (line_dedup.signatures(lines)[:, line_dedup.BANDS : 2 * line_dedup.BANDS] != 0).mean() > 0.95
    assert sum(seen) < 0.2 * sum(map(len, lines))
