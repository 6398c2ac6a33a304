"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

# What a word, a sentence, a clause and a phrase are.
TOKEN = r"[a-zA-Z][a-zA-Z0-9+#\-']*[a-zA-Z0-9+#]|[a-zA-Z]"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"
CLAUSE_BREAK = r"[.,;:!?()\[\]\"“”…/]|\s[-–—]\s"
PHRASE_WORD = r"[a-z][a-z0-9+#\-]*(?:'s)?"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f uses it: each use of an expression in a lambda or a branch would work it out anew."""
    return F.element_at(F.transform(F.array(c), f), 1)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unescape(c: Column) -> Column:
    """The XML entities and the no-break space; the ampersand last, so that one level goes at a time."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def clean_caption(c: Column) -> Column:
    c = F.regexp_replace(unescape(unescape(F.coalesce(c, F.lit("")))), L.NOISE, " ")
    c = F.regexp_replace(c, r"^\s*(?:>>|-)\s*", "")
    return squeeze(F.regexp_replace(c, L.FILLED_PAUSE, "$1$2"))


def is_new_speaker(c: Column) -> Column:
    return unescape(F.coalesce(c, F.lit(""))).rlike(L.NEW_SPEAKER)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def truncated(c: Column, limit: int) -> Column:
    whole = squeeze(F.coalesce(c, F.lit("")))
    head = F.left(whole, F.lit(limit - 1))
    space = F.length(head) - F.instr(F.reverse(head), F.lit(" "))  # its index from 0, or the length
    kept = F.when(F.contains(head, F.lit(" ")) & (space > limit * 0.6), F.left(head, space)).otherwise(head)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(kept, F.lit(",;: ")), F.lit("…")))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def titled(c: Column) -> Column:
    def word(w: Column, i: Column) -> Column:
        loud = (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)
        small = (i > 0) & F.lower(w).isin(L.SMALL_WORDS)
        return F.when(loud, w).when(small, F.lower(w)).otherwise(upper_first(w))

    return F.array_join(F.transform(words(c), word), " ")


def clock(seconds: Column) -> Column:
    """h:mm:ss or m:ss; null is empty."""
    s = F.greatest(F.lit(0), seconds.cast("bigint"))
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(seconds.isNull(), F.lit("")).when(s >= 3600, long).otherwise(short)


def seconds_of(c: Column) -> Column:
    """The base-60 value of a clock text; null if a part is no number."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: F.trim(p).try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p)


def distinct_in_order(c: Column) -> Column:
    """The first of equal items (by trimmed lower case); blank ones go. Items are sorted, so the work is that of a sort, not of all pairs."""
    held = F.filter(c, lambda x: F.trim(x) != "")
    placed = F.sort_array(F.transform(held, lambda x, i: F.struct(F.lower(F.trim(x)).alias("key"), i.alias("i"), x.alias("x"))))
    # an array of one, whose item has a name in the lambda: an expression that is looked into there would be made anew for every item
    first = F.get(F.transform(F.array(placed), lambda s: F.filter(s, lambda y, k: (k == 0) | (y["key"] != F.get(s, k - 1)["key"]))), F.lit(0))
    return F.transform(F.sort_array(F.transform(first, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def candidate_phrases(c: Column, most: int = 3) -> Column:
    """Runs of 1 to most words within a clause that can be a noun phrase. Repeated ones stay: they are counted."""
    def fits(g: Column) -> Column:
        # isin becomes one look into a hash set
        first, last, n = F.element_at(g, 1), F.element_at(g, -1), F.size(g)
        outer = ~first.isin(L.STOPS) & ~last.isin(L.STOPS) & ~last.isin(L.EDGE_ADJECTIVES)
        inner = ~F.exists(F.slice(g, 2, F.greatest(n - 2, F.lit(0))), lambda w: (w != "of") & w.isin(L.STOPS))
        return outer & inner & ~F.exists(g, lambda w: (F.length(w) < 2) | w.endswith("ly") | w.isin(L.VERBS))

    def runs(ws: Column) -> Column:
        def of_size(n: int) -> Column:
            starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.slice(ws, i, n))

        return F.concat(*[of_size(n) for n in range(1, most + 1)])

    clauses = F.split(F.lower(c), CLAUSE_BREAK)
    grams = F.flatten(F.transform(clauses, lambda k: runs(F.regexp_extract_all(k, F.lit(PHRASE_WORD), F.lit(0)))))
    return F.transform(F.filter(grams, fits), lambda g: F.array_join(g, " "))


def compressed(c: Column, most: int) -> Column:
    """A short line: no lead-ins; if it is too long, up to the last clause end that leaves 4 to most words."""
    ends = r",|;|\s(?:which|because|so that|whereas|while|although)\s|\s[-–—]\s"

    def without_lead(t: Column) -> Column:
        return F.rtrim(bound(F.regexp_replace(t, L.LEAD_INS, ""), lambda bare: F.when(bare == "", t).otherwise(bare)), F.lit(" .;,"))

    def of_pieces(t: Column, ws: Column, pieces: Column) -> Column:
        heads = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
            lambda k: F.rtrim(F.replace(F.array_join(F.slice(pieces, 1, k), ""), F.lit("\u0002"), F.lit("")), F.lit(" ,;:")),
        )
        fit = F.filter(heads, lambda h: (F.size(pieces) > 1) & F.size(words(h)).between(4, most))
        cut = F.concat(F.rtrim(F.array_join(F.slice(ws, 1, most), " "), F.lit(",;:")), F.lit("…"))
        return F.coalesce(F.try_element_at(fit, F.lit(-1)), cut)

    def of_words(t: Column, ws: Column) -> Column:
        pieces = F.split(F.regexp_replace(t, f"(?i)({ends})", "\u0001$1\u0002"), "\u0001")
        return F.when(F.size(ws) <= most, t).otherwise(bound(pieces, lambda held: of_pieces(t, ws, held)))

    bare = bound(F.regexp_replace(squeeze(c), '^[“”"]+|[“”"]+$', ""), without_lead)
    return bound(bound(bare, lambda t: bound(words(t), lambda ws: of_words(t, ws))), upper_first)


def meaning(text: Column, term: Column) -> Column:
    """What a line says that the term (in lower case) is or does, in ten words; null where it says nothing in three words or more."""
    at = F.instr(F.lower(text), term)
    rest = F.regexp_replace(F.ltrim(F.substring(text, at + F.length(term), F.lit(1 << 30)), F.lit(" ,")), r"^(?:'s|s)\b\s*", "")

    def of(rest: Column) -> Column:
        defined = F.regexp_replace(F.regexp_replace(rest, L.COPULA, ""), L.ARTICLE, "")
        verb = F.btrim(F.lower(F.try_element_at(words(rest), F.lit(1))), F.lit(",."))
        return F.when(rest.rlike(L.COPULA), defined).when(verb.isin(L.VERBS), rest)

    def short(said: Column) -> Column:
        return F.when(said.isNotNull(), bound(compressed(said, 10), lambda line: F.when(F.size(words(line)) >= 3, lower_first(line))))

    return F.when(at > 0, bound(bound(rest, of), short))


def line_tag(c: Column) -> Column:
    tag = F.lit(None).cast("string")
    for name, pattern in reversed(L.TAGS.items()):
        tag = F.when(c.rlike(pattern), F.lit(name)).otherwise(tag)
    return tag


def ascii_share(c: Column) -> Column:
    """Share of a text's letters that are ASCII."""
    return F.regexp_count(c, F.lit("[A-Za-z]")) / F.greatest(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(1))


def plain(c: Column) -> Column:
    return F.btrim(c, F.lit('“”" '))


def lower_first(c: Column) -> Column:
    def of(t: Column) -> Column:
        head = F.left(t, F.lit(2))
        loud = (F.upper(head) == head) & (F.lower(head) != head)
        return F.when(loud, t).otherwise(F.concat(F.lower(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30)))

    return bound(c, of)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def untagged(c: Column) -> Column:
    return F.regexp_replace(c, "^(Formula|Eg|Watch-out|Tip|Def): ", "")


def time_range(start: Column, end: Column) -> Column:
    return F.when(end > start, F.concat(clock(start), F.lit("–"), clock(end))).otherwise(clock(start))


def clean_label(c: Column, most_chars: int, most_words: int) -> Column:
    """A label without marks and times; null if nothing usable is left."""
    t = F.replace(F.replace(c, F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    t = squeeze(F.regexp_replace(t, r"\[?\(?\b\d{1,2}:\d{2}(?::\d{2})?\b\)?\]?", " "))
    t = F.trim(F.rtrim(F.btrim(t, F.lit("\"'“”‘’")), F.lit(".;,")))
    t = F.regexp_replace(t, r"\s+:", ":")
    bad = (t == "") | t.rlike(L.ABOUT_VIDEO) | ~t.rlike("[A-Za-z0-9]") | (F.size(words(t)) > most_words) | (F.length(t) > most_chars)
    return F.when(~bad, t)


def fuzzy_score(query: Column, text: Column) -> Column:
    q, t = F.lower(F.trim(query)), F.lower(text)
    qs = F.filter(words(q), lambda w: F.length(w) > 1)
    share = F.size(F.filter(qs, lambda w: F.contains(t, w))) / F.greatest(F.size(qs), F.lit(1))
    held = F.lit(0.85) - F.least(F.lit(0.3), (F.length(t) - F.length(q)) / F.lit(400.0))
    return F.when((q == "") | (t == ""), F.lit(0.0)).when(q == t, F.lit(1.0)).when(F.contains(t, q), held).otherwise(F.lit(0.7) * share)


def slug(c: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(60))


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over the characters' codes."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    step = lambda h, x: ((h.bitwiseXOR(F.ascii(x).cast("bigint"))) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), step)


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def usable_phrase(c: Column) -> Column:
    """1 to 4 words, none twice, no stop word at an end, at least one that carries meaning."""
    ws = words(c)
    ends = ~F.try_element_at(ws, F.lit(1)).isin(L.STOPS) & ~F.try_element_at(ws, F.lit(-1)).isin(L.STOPS)
    shape = F.size(ws).between(1, 4) & (F.length(c) >= 3) & ~c.rlike(r"^\d+$") & (F.size(F.array_distinct(ws)) == F.size(ws))
    return F.coalesce(shape & ends, F.lit(False))


def prefer_phrases(c: Column, most: int) -> Column:
    """Without the single words that a chosen pair has, in rank order."""

    def of(held: Column) -> Column:
        pairs = F.filter(held, lambda x: F.contains(x, F.lit(" ")))
        covered = F.flatten(F.transform(pairs, lambda p: F.split(p, " ")))
        return bound(covered, lambda ws: F.filter(held, lambda x: F.contains(x, F.lit(" ")) | ~F.array_contains(ws, x)))

    return F.slice(bound(c, of), 1, most)


def keyword_title(c: Column) -> Column:
    """The first keyword, and the next that shares no word with it."""

    def of(held: Column) -> Column:
        first = F.try_element_at(held, F.lit(1))
        second = bound(F.split(first, " "), lambda ws: F.try_element_at(F.filter(held, lambda x: ~F.arrays_overlap(F.split(x, " "), ws)), F.lit(1)))
        return F.when(first.isNull(), F.lit(None)).otherwise(F.concat(titled(first), F.coalesce(F.concat(F.lit(" & "), titled(second)), F.lit(""))))

    return bound(c, of)


def tones(c: Column, most: int = 2) -> Column:
    """(tone, score) of the strongest tones; ties in the order of the list."""
    marks = F.length(c) - F.length(F.replace(c, F.lit("!"), F.lit("")))
    none = F.array().cast("array<struct<tone:string,score:double>>")

    def of(ts: Column) -> Column:
        def scored(k: int, name: str) -> Column:
            hits = F.size(F.filter(ts, lambda t: t.isin(L.TONES[name]))).cast("double")
            hits = hits + marks * 0.5 if name == "enthusiastic" else hits
            score = hits * (F.lit(1000.0) / F.greatest(F.size(ts), F.lit(1)))
            return F.struct((-F.round(score / L.TONE_LEVELS[name], 2)).alias("low"), F.lit(k).alias("k"), F.lit(name).alias("tone"), (score >= L.TONE_LEVELS[name]).alias("earned"))

        every = F.array(*[scored(k, n) for k, n in enumerate(L.TONES)])
        best = F.slice(F.array_sort(F.filter(every, lambda x: x["earned"])), 1, most)
        found = F.transform(best, lambda x: F.struct(x["tone"].alias("tone"), (-x["low"]).alias("score")))
        return F.when(F.size(ts) > 0, found).otherwise(none)

    # bound once: each use of an expression would cut the text into words again
    return F.element_at(F.transform(F.array(tokens(c)), of), 1)


def merged_tones(lexical: Column, given: Column) -> Column:
    """Given tones that are known first, then those found; three at most."""
    known = [*L.TONES, *L.OTHER_TONES]
    return F.slice(F.array_distinct(F.concat(F.filter(F.transform(given, F.lower), lambda t: t.isin(known)), lexical)), 1, 3)
