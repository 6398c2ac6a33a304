"""Script and language of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import bound

#: Languages that captions come in, and the script that each is written in.
LANGUAGES = {
    **{k: "Latn" for k in "en de es fr it pt nl sv no da fi pl cs sk hu ro tr vi id ms sw af sq bs hr lt lv et tl zu".split()},
    "ru": "Cyrl", "uk": "Cyrl", "bg": "Cyrl", "sr": "Cyrl", "el": "Grek", "he": "Hebr", "ar": "Arab", "fa": "Arab", "ur": "Arab", "hi": "Deva",
    "mr": "Deva", "ne": "Deva", "bn": "Beng", "ta": "Taml", "te": "Telu", "th": "Thai", "ka": "Geor", "hy": "Armn", "ko": "Hang", "ja": "Jpan", "zh": "Hans",
}
LATIN_LETTER = r"[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]"


def script_counts(c: Column) -> Column:
    """(script, letters), with kanji counted as Japanese where there is kana."""
    # no letter of these scripts is ASCII: what is left is read once for each script
    return bound(F.regexp_replace(c, r"[\x00-\x7F]+", ""), _script_counts)


def _script_counts(c: Column) -> Column:
    codes = list(dict.fromkeys(code for _, code, _ in L.SCRIPTS))
    count = lambda code: F.regexp_count(c, F.lit("[" + "".join(rf"\p{{Is{n}}}" for n, k, _ in L.SCRIPTS if k == code) + "]"))
    kana, han = count("Jpan"), count("Hans")
    pair = bound(F.struct(kana.alias("kana"), han.alias("han")), lambda p: F.when(p["kana"] > 0, F.struct((p["kana"] + p["han"]).alias("Jpan"), F.lit(0).alias("Hans"))).otherwise(F.struct(F.lit(0).alias("Jpan"), p["han"].alias("Hans"))))
    alone = {k: count(k) for k in codes if k not in ("Jpan", "Hans")}
    return bound(pair, lambda p: F.array(*[F.struct((alone[k] if k in alone else p[k]).cast("int").alias("n"), F.lit(k).alias("script")) for k in codes]))


def main_script(c: Column) -> Column:
    """(script, share): the commonest script but Latin, and the share of all letters that such scripts have."""

    def of(s: Column) -> Column:
        top, other = F.array_max(s["counts"]), s["other"]
        return F.struct(F.when(other > 0, top["script"]).alias("script"), F.when(other > 0, other / (other + s["latin"])).otherwise(F.lit(0.0)).alias("share"))

    def summed(t: Column, counts: Column) -> Column:
        other = F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"])
        return F.struct(counts.alias("counts"), other.alias("other"), F.regexp_count(t, F.lit(LATIN_LETTER)).alias("latin"))

    # bound: each use of a text or of its counts would search the text again
    return bound(c, lambda t: bound(bound(script_counts(t), lambda counts: summed(t, counts)), of))


def needs_translation(c: Column) -> Column:
    return main_script(c)["share"] > 0.2


def english_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))


def english_hits(c: Column) -> Column:
    return F.size(F.filter(english_words(c), lambda w: w.isin(L.ENGLISH)))


def english_ratio(c: Column) -> Column:
    hits = lambda ws: F.size(F.filter(ws, lambda w: w.isin(L.ENGLISH)))
    return bound(english_words(c), lambda ws: F.when(F.size(ws) > 0, hits(ws) / F.size(ws)).otherwise(F.lit(0.0)))


def normal_code(c: Column) -> Column:
    """The known language of a code such as a.EN or pt_BR, else null."""
    code = F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")), r"^a\.", "")
    base = F.split_part(code, F.lit("-"), F.lit(1))
    return F.when(code.isin(list(LANGUAGES)), code).when(base.isin(list(LANGUAGES)), base)


def _of_script(hint: Column, script: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    likely = F.create_map(*[F.lit(x) for code, lang in {code: lang for _, code, lang in L.SCRIPTS}.items() for x in (code, lang)])
    return F.when(F.element_at(table, hint) == script, hint).otherwise(F.element_at(likely, script))


def detected(sample: Column, hint: Column) -> Column:
    """The script decides, then English function words, then the hint; else English."""

    def of(t: Column, found: Column) -> Column:
        return (
            F.when(found["share"] >= 0.3, _of_script(hint, found["script"]))
            .when(english_ratio(t) >= 0.2, F.lit("en"))
            .when(hint.isNotNull() & (hint != "en"), hint)
            .otherwise(F.lit("en"))
        )

    return bound(sample, lambda t: bound(main_script(t), lambda found: of(t, found)))


def unit_language(c: Column, video: Column) -> Column:
    """The language of one unit of a video: English parts of other videos are told apart."""
    found, hits = main_script(c), english_hits(c)
    latin = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), video) == "Latn", F.lit(False))
    return (
        F.when(found["share"] >= 0.3, _of_script(video, found["script"]))
        .when((hits >= 2) & (hits / F.greatest(F.size(english_words(c)), F.lit(1)) >= 0.15), F.lit("en"))
        .when((video == "en") | ~latin, F.lit("en"))
        .otherwise(video)
    )
