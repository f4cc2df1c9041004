"""Languages of which little is known."""

import random

import numpy as np
import pyarrow.parquet as pq

from folioscope.llm import language

SF = "/root/testdata/sf0.01"


def test_a_small_language_beside_large_ones():
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang"]).to_pandas().dropna().drop_duplicates().sort_values(["lang", "text"])
    texts, rest = {}, {}
    for lang, of in docs.groupby("lang"):
        plain = [t for t in map(language.plain, of.text.sample(frac=1, random_state=7)) if len(t) > 100]
        if lang == "en":
            texts[lang], rest[lang] = [plain[0][:200]], plain[1:60]
        else:
            many = b" ".join(plain)
            texts[lang], rest[lang] = [many[:24_000]], [many[k : k + 500] for k in range(24_000, len(many), 500)][:60]
    model = language.build(texts)
    for lang, of in rest.items():
        assert np.mean([n == lang for n in language.predict(model, [t.decode("utf-8", "ignore") for t in of])[0]]) > 0.9, lang


def test_phrases_of_held_back_text():
    assert language.held_back(b"") == language.held_back(b"abc") == 1.0
    assert language.held_back(b"abcd") == 1.0  # nothing is in the rest
    assert language.held_back(b"abcabc abcabc abcabc abcabc ") == 0.0


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    names = [f"l{k:02d}" for k in range(70)] + ["long", "longer", "copied", "junk"]
    vocabulary = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäéñ", k=rng.randint(3, 8))) for _ in range(40)] for n in names}

    def text(n, k):
        return " ".join(rng.choices(vocabulary[n], k=k))

    rows = [(k, text(n, 80), n) for k, n in enumerate(names[:70])]
    rows += [(100, text("long", 2000), "long"), (101, text("longer", 6000), "longer"), (102, text("longer", 5000), "longer")]  # above 8,000 characters; above the budget
    same = text("copied", 3)
    rows += [(200 + k, same, "copied") for k in range(300)] + [(None, t, "copied") for t in [text("copied", 80)] * 2] + [(3, "12 3", "digits")]
    rows += [(600 + k, f"{k} " * 5, "junk") for k in range(200)] + [(900, text("junk", 80), "junk"), (901, "no label", None)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x.name for block in model.blocks for x in block] == sorted(names)
    asked = [(k, text(n, 40)) for k, n in enumerate(names)] + [(98, "12"), (99, None)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == dict(enumerate(names)) | {98: "und", 99: "und"}


def test_blocks_give_what_one_block_gives(monkeypatch):
    texts = {f"l{k}": [bytes(97 + (k * 7 + j * j) % 26 for j in range(300))] for k in range(9)} | {"same": [b"abc abd"], "twin": [b"abc abd"]}
    asked = [t[0].decode() for t in texts.values()] + [None, "", "abc", "xyzzy"]
    whole = language.predict(language.build(texts), asked)
    monkeypatch.setattr(language, "BLOCK", 2)
    parted = language.build(texts)
    assert len(parted.blocks) == 6 and language.predict(parted, asked) == whole and whole[0][9:11] == ["same", "same"]


def test_segments_change_no_phrase(monkeypatch):
    rng = random.Random(9)
    learned = [bytes(rng.choices(b"abc ", k=400)), b"ab" * 300, bytes(rng.choices(b"abcdefgh ", k=700))]
    block = language.tabulated([language.learned(str(k), t) for k, t in enumerate(learned)])
    asked = [bytes(rng.choices(b"abcz ", k=n)) for n in (0, 1, 7, 63, 64, 65, 2000)] + [b"ab" * 900, b"z" * 500, learned[2][:650] + b"q" + learned[2]]
    monkeypatch.setattr(language, "SEGMENT", 1 << 30)
    whole = language.phrases(block, asked)
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(language, "SEGMENT", size)
        assert (language.phrases(block, asked) == whole).all(), size


def test_a_language_of_one_very_long_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(200)]
    other = ["".join(rng.choices("mnopqrstuvwxyz", k=5)) for _ in range(200)]
    long = " ".join(rng.choices(words, k=700_000))
    rows = [(1, long, "long"), *[(k, " ".join(rng.choices(other, k=80)), "short") for k in range(2, 40)]]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(x.states < 2 * language.SAMPLE_BYTES for x in model.blocks[0])
    assert language.predict(model, [long, " ".join(rng.choices(words, k=30)), " ".join(rng.choices(other, k=30))])[0] == ["long", "long", "short"]
