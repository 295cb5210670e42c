import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with edges: null, empty and blank texts, a long one, copies, near copies and shared passages."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, text(3)), (6, text(9000)), (7, "x" * 50000)]
    base = text(120)
    for i in range(10, 40):
        rows.append((i, base if i < 20 else base.replace(" ", f" {words[i]} ", 1) if i < 30 else base + " " + words[i]))
    for i in range(40, 60):
        rows.append((i, text(rng.randint(10, 150)) + " " + passage + "\n" + text(20)))
    rows += [(60 + i, text(rng.randint(1, 200))) for i in range(30)]
    rows += [(90, text(40) + "  double  spaces\tand more ▁ marks <s> \x00 \U0001f600 é"), (91, "CAFÉ ﬁne"), (92, "café   fine")]
    return {i: t for i, t in rows}


@pytest.fixture(scope="session")
def frame(spark, docs):
    """``docs`` as a table with extra columns whose names operators use inside."""
    rows = [(i, t, "en", "src", None if t is None else len(t), "k", "v") for i, t in docs.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk string, key string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, frame):
    return spark.createDataFrame([], frame.schema)


@pytest.fixture(scope="session")
def saved(spark, frame, tmp_path_factory):
    """A folder with ``documents``, ``labels`` and other small tables."""
    top = tmp_path_factory.mktemp("tables")
    frame.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(3, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)
