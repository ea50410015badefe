import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rn_ int, node string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empties, copies, near copies, repeated rows, long texts and columns whose names clash."""
    rng = random.Random(5)
    base = [sentence(rng, 120) for _ in range(12)]
    passage = sentence(rng, 110)
    texts = [None, "", " \t\n", "one", "two words", *base]
    texts += [base[0], base[0]]  # exact copies
    near = base[1].split()
    texts += [" ".join([*near[:60], "changed", *near[61:]]), " ".join([*near[:30], "other", *near[31:]])]
    texts += [sentence(rng, 60) + " " + passage + " " + sentence(rng, 60) for _ in range(4)]
    texts += ["the " * 3000, "é" * 900, "日本語 テキスト " * 200, "###$$$ %%% " * 40, "a|b\n" * 120]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), 1, "x") for i, t in enumerate(texts)]
    rows += [rows[6], (None, base[2], None, None, 3, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
