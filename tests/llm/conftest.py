import pytest

from tests.conftest import partitions, spark  # noqa: F401

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("tan", "ver", "sil", "mon", "dar", "fel", "gus")]


def prose(dice, n, per_line=12):
    out = []
    for i in range(n):
        w = dice.choice(WORDS)
        out.append(w.capitalize() + ("\n" if i % per_line == per_line - 1 else " "))
    return "".join(out).strip() + "."


@pytest.fixture(scope="session")
def docs(spark):  # noqa: F811
    """Texts with copies, near copies, passages, ties, nulls, long and empty texts, odd bytes."""
    import random

    dice = random.Random(3)
    plain = [prose(dice, dice.randint(5, 260)) for _ in range(60)]
    passage = prose(dice, 60)
    texts = list(plain)
    texts += [plain[0]] * 12 + [plain[1].upper()] + [plain[2] + " tail"] * 2
    for k in range(25):  # near copies of one text
        w = plain[3].split(" ") if len(plain[3]) > 600 else (plain[3] + "\n" + passage + "\n" + plain[4]).split(" ")
        w[dice.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [plain[5 + k] + "\n" + passage + "\n" + plain[20 + k] for k in range(10)]
    texts += [prose(dice, 9000), "ab" * 700, "For " * 400, "\n".join(["same line of words here and there"] * 30)]
    texts += [None, "", " \t\n ", "one", "One", "one two three", "\x00\x1c odd sep été \U0001f600 x", "<|endoftext|> mark"]
    texts += ["The MIT  license, the General-Public\nLICENSE and an apache_license.", "xmit license mit licenses MIT\x7flicense"]
    texts += ["Licensed under CC BY-NC 4.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else ["a", "B", "é", "z", "big", "big", "big"][i % 7]
        rows.append((i, t, "en", source, len(t) if t else 0, i, "clash"))
    rows += [rows[7], rows[7], rows[64]]  # repeated rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]
