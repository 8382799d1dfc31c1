import random

import pytest


def made_texts() -> list:
    """Small and awkward texts: null, empty, white space, copies, near copies, shared passages, one long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 5))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    join = lambda w: " ".join(w)
    passage, base = words(60), words(120)
    texts: list = [None, "", "   \n\t ", "one", "Two words", "THREE of them", "three OF them", "a b c d", "a b c d e"]
    texts += [join(words(30) + passage + words(r.randint(0, 40))) for _ in range(6)]
    for k in range(12):
        near = list(base)
        for _ in range(k // 3):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        texts.append(join(near))
    texts += [join(base)] * 4 + [join(base).upper(), join(base).replace(" ", "\n", 3)]
    texts += ["x " * 300, "Ein Satz, und noch einer.\n" * 8, "home | about | news | contact | 2024\n" + join(words(80)) + ".", "\n".join(join(words(9)).capitalize() + "." for _ in range(12))]
    texts += ["it's 'quoted' don't stop　  <|endoftext|> \x00 \U0001f600 漢字 " + join(words(20)), 'key: password=3f9a0c1d2e4b5a6978 and token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffeeddcc" end', join(words(5000)), "y" * 3000]
    texts += [join(words(r.randint(1, 90))) for _ in range(60)]
    return texts


@pytest.fixture(scope="session")
def rows():
    out = [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "x", i) for i, t in enumerate(made_texts())]
    return out + [out[20], out[0]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blk string, size long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Rows repeat, and two columns have names that the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
