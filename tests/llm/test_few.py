import random

import numpy as np

from sitegrain.llm import line_dedup


def test_unlike_lines_of_few_symbols_share_no_band():
    rng = random.Random(2)
    lines = [" ".join(rng.choice(words) for _ in range(40)) for words in ([("".join(rng.choice("abcdefghij") for _ in range(5))) for _ in range(4)] for _ in range(200))]
    few = line_dedup.signatures(lines)[:, 2 * line_dedup.BANDS :]
    assert (few != 0).all() and len(np.unique(few)) > 0.95 * few.size
