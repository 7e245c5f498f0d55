"""A small corpus with what the operators have to cope with."""

import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, h1 long, component string"


def corpus():
    """(doc_id, text): copies, near copies, shared passages, ties, nulls, empty and long texts, odd blanks, other scripts."""
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(400)] + ["Grün", "naïve", "中文字", "🙂", "x"]
    some = lambda n: " ".join(draw.choices(words, k=n))
    passage, long, base = some(60), some(6000), some(80)
    texts = [None, "", " ", "\t\n\x0b", "one", "one two", "one", "a\xa0b c", "a\x1cb c", "A b c d e f", "a B c d e f", "xy" * 400, "aaaa " * 300, "ab" * 30 + "é" * 60 + "ab" * 30]
    texts += [some(draw.randint(1, 200)) for _ in range(60)]
    texts += [some(20) + " " + passage + " " + some(20) for _ in range(8)] + [passage, long, long + " tail", some(10) + " " + long]
    for share in (2, 5, 12, 30):
        for _ in range(6):
            parts = base.split()
            for i in draw.sample(range(len(parts)), share):
                parts[i] = draw.choice(words)
            texts.append(" ".join(parts))
    texts += [base] * 40 + [texts[20]] * 3
    texts += [
        "write to ann.lee+x@mail.example.org or b@c.d, bad@x, a@b.c@d.e and a..b@c-d.ef.", "host 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 0010.1.1.1 256.1.1.1",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 0 5500 0000 0000 0004", "call +49 (30) 1234-5678 or +1 2 or +12345678901234567890 or +44 20 7946 0958.",
        "iban DE89 3704 0044 0532 0130 00 and ssn 123-45-6789 for the taxpayer", "🙂 é x@y.zz 🙂 1.1.1.1", "end <|endoftext|> here<|endoftext|>",
        "Under the MIT License. Apache license; general  public-license; not mitlicense nor MIT License", "SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)\nGNU General Public License general public license",
        "SPDX-License-Identifier: ((GPL-2.0 WITH Classpath-exception-2.0\nlicensed under the Apache License Version 2.0 MIT LICENSE",
    ]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The corpus as a table of several files with further columns, whose names operators may use inside."""
    draw = random.Random(3)
    full = [(i, t, draw.choice(["en", "de", None]), draw.choice(["web", "books", None]), len(t) if t else None, 5, "z") for i, t in rows]
    draw.shuffle(full)
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(full, KINDS).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
