import itertools

import pytest


@pytest.fixture
def make(spark):
    """make(rows, schema) with a column of another's name and one of no use besides."""

    def build(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' AS component_id", "1 AS `print`", "'y' AS spans", "2.0 AS score", "'r' AS rules", "'l' AS lang_pred", "7 AS host", "9 AS node")

    return build


def find_roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.fixture
def roots():
    return find_roots


@pytest.fixture
def texts():
    import random

    rnd = random.Random(5)
    letters = "ab▁  \n\té日½'s'lld_-=*#\x85\xa0́0ΣZ"
    odd = ["", " ", "  a", "a  b ", "x▁y", "▁", "a▁", "\n\n", "日本語𝒳 ", " ﬁ½ Åａ\x00\x01", "a" * 3000, "=" * 500, " " * 70, "it's DON'T ''s I'LL", "<|endoftext|>x <|startoftext|>", "\x1c\x1d a\x85b\xa0c", "İSTANBUL ΣΑΣ ǅ ŉ", "²³ ½ ªº µ ÷×", "_a_b__c", "<s> </s> <0x0A>", None]
    return odd + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(300)] + [" ".join(itertools.repeat("lorem ipsum dolor", 4000))]
