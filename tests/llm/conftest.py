import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under pale moonlight near old stone towers".split()


def sentence(seed: int, n: int) -> str:
    """Words that differ from one seed to another."""
    return " ".join(f"{WORDS[(seed * 7 + i * i + 3 * i) % len(WORDS)]}{(seed * 31 + i) % 17}" for i in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and white texts, copies, near copies, ties, very long ones, odd characters."""
    base = sentence(1, 60)
    near = base.replace(base.split()[30], "changed")
    rows = [
        (0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "One"), (5, base), (6, base), (7, near), (8, base + " tail"),
        (9, "été ça ß ñandú — “quoted” text's end"), (10, sentence(2, 40)), (11, sentence(3, 4000)), (12, "x" * 30000),
        (13, "a  b\n\nc \n d"), (14, sentence(4, 25)), (15, ""), (16, None), (17, "!!! ... ???"), (18, sentence(2, 40)), (19, "日本語 テキスト"),
        (20, "<|endoftext|> is ordinary here"), (21, "line one\nline two\nline one"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those texts with the columns of documents, one whole row repeated, and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", len(t or ""), i, "x", 1.5, i, b"k") for i, t in texts]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, shard string, score double, size bigint, chunk binary"
    return spark.createDataFrame([*rows, rows[3]], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
