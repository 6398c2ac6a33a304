import numpy as np
import pytest

from chronoloom.llm import language


def model(texts):
    """texts: of each language."""
    counted = []
    for own in texts.values():
        data = [t.encode() for t in own]
        codes = language.grams(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
        counted.append(np.unique(codes, return_counts=True))
    return language.model_of(list(texts), counted)


def ppm_bits(texts, text):
    """Method C with exclusions, from dictionaries: of each byte the bits."""
    seen = {}
    for t in texts:
        padded = bytes([language.START] * language.ORDER) + t.encode()
        for i in range(language.ORDER, len(padded)):
            for k in range(language.ORDER + 1):
                own = seen.setdefault(padded[i - k : i], {})
                own[padded[i]] = own.get(padded[i], 0) + 1
    padded, out = bytes([language.START] * language.ORDER) + text, []
    for i in range(language.ORDER, len(padded)):
        p, excluded = 1.0, set()
        for k in range(language.ORDER, -1, -1):
            own = {b: n for b, n in seen.get(padded[i - k : i], {}).items() if b not in excluded}
            if not own:
                continue
            total = sum(own.values()) + (len(own) if len(own) < 256 - len(excluded) else 0)
            if padded[i] in own:
                p *= own[padded[i]] / total
                break
            p *= len(own) / total
            excluded |= set(own)
        else:
            p /= 256 - len(excluded)
        out.append(-np.log2(p))
    return out


TEXTS = {
    "en": ["the cat sat on the mat", "a hat that the cat had", "then there", ""], "fr": ["le chat est sur le tapis", "à côté de la forêt où il était", "ça"],
    "ru": ["кот сидел на ковре", "там кот"], "ja": ["猫がいる", "犬もいる"], "all": [bytes(range(1, 128)).decode(), "aaaa"],
}


@pytest.mark.parametrize("text", ["the cat", "le chat à côté", "кот на ковре кот", "猫と犬", "", "x", "\n\n\n\n\n", "a" * 50, "\x00\x01zz\U0001f600 the mat that thethe"])
def test_against_another_ppm(text):
    """Code lengths of all languages at once are those of each language's own coder, byte by byte."""
    m = model(TEXTS)
    data = text.encode()
    want = np.array([sum(ppm_bits(own, data)) for own in TEXTS.values()])
    before = "the cat le chat кот".encode()  # other texts in the same batch
    both = np.frombuffer(before + data + before, np.uint8)
    got = language.text_bits(both, np.array([0, len(before), len(before) + len(data), len(both)]), m)
    assert np.allclose(got[1], want, rtol=1e-5, atol=1e-4) and np.allclose(got[0], got[2])


def test_probabilities_sum_to_one():
    """After any context, met or not, the 256 bytes share all of the probability, so the lengths are those of a code."""
    m = model(TEXTS)
    for context in ["the ", "le c", "\n\n\nl", "zzzz", "xthe", "кот"[:2], "猫", "aaaa", "\x01\x02\x03\x04"]:
        c = context.encode()[-4:]
        codes = np.array([int.from_bytes(c + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert np.allclose(np.exp2(-language._bits(4, codes, m)[0].astype(float)).sum(axis=0), 1, atol=1e-4)


def test_keys():
    rng = np.random.default_rng(2)
    held = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    asked = np.concatenate([held, rng.integers(0, 1 << 40, 5000).astype(np.uint64)])
    at = {int(k): j for j, k in enumerate(held)}
    assert language.Keys(held).rows(asked).tolist() == [at.get(int(k), -1) for k in asked]
    assert language.Keys(held[:0]).rows(asked[:3]).tolist() == [-1] * 3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = language.op4_ppm_language_id(spark, folder).where("held_out")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_near_languages_and_short_texts(spark):
    """Languages that share their letters and most of their words, told apart by ten words."""
    rng = np.random.default_rng(8)
    syllable = lambda: "".join(rng.choice(list(x)) for x in ("bdfgklmnprst", "aeiou", "lnrs "))
    shared = [syllable() + syllable() for _ in range(300)]
    own = {k: [syllable() + end for _ in range(120)] for k, end in {"xa": "ão", "xb": "ón", "xc": "on"}.items()}
    text = lambda k, n: " ".join(rng.choice(own[k] if rng.random() < 0.4 else shared) for _ in range(n))
    rows = [(k, text(("xa", "xb", "xc")[k % 3], 60), ("xa", "xb", "xc")[k % 3]) for k in range(300)] + [(1000 + k, text(("xa", "xb", "xc")[k % 3], 10), ("xa", "xb", "xc")[k % 3]) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.train(docs.where("doc_id < 1000"))
    found = language.predict(docs.where("doc_id >= 1000"), m, keep=["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_trained_model_and_its_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, own in TEXTS.items() for t in own)], "doc_id long, text string, lang string")
    m, same = language.train(docs), model(TEXTS)
    order = [m.languages.index(k) for k in TEXTS]
    data = np.frombuffer("the cat chat кот 猫".encode(), np.uint8)
    ends = np.array([0, len(data)])
    assert np.allclose(language.text_bits(data, ends, m)[0][order], language.text_bits(data, ends, same)[0], rtol=1e-5)
    assert len(language.train(docs, kept=7).strings[4].keys) <= 7 * len(TEXTS)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="languages"):
        language.train(docs)


def test_odd_rows(odd, none):
    model = language.train(odd)
    rows = language.predict(odd, model, keep=["text"]).collect()
    assert len(rows) == odd.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {2, 3, 4} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.train(none) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, model).count() == 0
