import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, part int, size int, a long"


def make_docs():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = say(60)
    texts = [say(rng.randint(20, 200)) for _ in range(60)]
    base = say(150).split()
    for i in range(40):  # near copies
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [base_text := " ".join(base)] * 12 + [say(30) + " " + shared + "\n" + say(30) for _ in range(15)]
    texts += [None, "", " \t\n", "one", "Two words", "one", "TWO words", "x\x0by z\x1cw", "line\nline\nline\n\nother", say(30_000), "### $$$ %%% " * 40, "а б в г д", "日本 語", "1 2 3"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", "s1", "s1", None)[i % 5], len(t or ""), "x", i, 1, 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base_text, None, None, None, None, None, None, None), (None, "lost words here", "en", "s2", 1, "y", 1, 1, 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def fixture_dir(spark, docs, tmp_path_factory):
    """The documents fixture as a data directory, with labels."""
    d = str(tmp_path_factory.mktemp("data"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, (1, 0, None)[i % 3], 0) for i in range(120)] + [(4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, empty, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for name, schema in (("documents", None), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        (empty if schema is None else spark.createDataFrame([], schema)).write.parquet(f"{d}/{name}.parquet")
    return d

