"""Lines that many benchmark items share."""

import numpy as np
import pyarrow as pa

from textrep.llm import decontaminate
from textrep.llm.words import split_words


def found(texts, items):
    tables = decontaminate.benchmark_patterns(pa.array(items), np.arange(len(items)))
    words = split_words(pa.array(texts), decontaminate.NOT_ALNUM, lower=True)
    names = np.array([str(i) for i in range(len(items))], dtype=object)
    return tables, [sorted(map(int, r["items"])) for r in decontaminate.search(words, tables, names).to_pylist()]


def plain(texts, items):
    def windows(text):
        w = text.split()
        return {tuple(w[k : k + 10]) for k in range(len(w) - 9)}

    return [[i for i, item in enumerate(items) if windows(item) & windows(text)] for text in texts]


def test_windows_of_a_shared_line_share_one_list_of_items():
    line = " ".join(f"common{i}" for i in range(40))
    items = [f"a{i} b{i} {line} c{i}" for i in range(200)] + [f"only {i} " + " ".join(f"q{j}" for j in range(i, i + 12)) for i in range(20)]
    texts = [f"x {line} y {line}", " ".join(f"q{j}" for j in range(5, 25)), f"a7 b7 {line}", "nothing of it", ""]
    tables, got = found(texts, items)
    assert got == plain(texts, items)
    assert len(tables[0].items) < 3 * len(items)  # not windows x items


def test_overlapping_sets_of_items():
    base = [f"w{i}" for i in range(60)]
    items = [" ".join(base[a:b]) for a, b in ((0, 20), (5, 30), (5, 30), (12, 50), (40, 60))]
    texts = [" ".join(base[a:b]) for a in range(0, 50, 7) for b in range(a + 8, 61, 9)]
    assert found(texts, items)[1] == plain(texts, items)
