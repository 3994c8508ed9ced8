"""Free-entered values to the entries of a reference list.

Different values are taken once and normalised. Their words are looked up in an inverted index of character n-grams over the words of the
list (and the openings of these words, for abbreviations) and scored by cosine, every n-gram weighted by its rarity. An entry's score for
a value is the weighted cosine over its fields: the best of its make, of its family and of its lens, and the number. A value is mapped to
the best entry if its score reaches the threshold and is ahead of the second by the margin; entries of another model number, suffix or
lens than the value names are left out by an exact check before.

Defined results: null and blank values map to nothing (-1), as do those without a number whose family isn't named surely; repeated rows of
a key count once; an empty reference list maps nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.runtime import broadcast_if_small, materialise

THRESHOLD, MARGIN = 0.37, 0.01
SURE = 0.6  # least cosine of a family named without a number
LEAST_COSINE = 0.05  # of a word with a word of the list; less says nothing
SHORTEST_OPENING = 3
# Suffixes that make another model.
SUFFIXES = ["pro", "rtk", "ii"]
_ORDINAL = re.compile(r"\b\d+(?:st|nd|rd|th)\b")
_LOOKS = str.maketrans("oil", "011")


@dataclass
class Value:
    """What a typed value says."""

    words: list[str]
    lens_words: list[str]
    number: str
    suffixes: str
    focal: int
    aperture: int
    make_words: list[str]  # of the make field alone, with all of it as one word


def fold(s: str | None) -> str:
    s = unicodedata.normalize("NFKD", (s or "").replace("ß", "ss").replace("ø", "o").replace("Ø", "o"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def _lens(text: str) -> tuple[int, int, str]:
    """Focal length in mm and aperture in tenths (-1: not said), and the text without them."""
    focal = aperture = -1
    if m := re.search(r"(?<!\d)(\d{1,4})\s*mm", text):
        focal, text = int(m[1]), text[: m.start()] + " " + text[m.end() :]
    if m := re.search(r"f\s*/?\s*(\d{1,2})\s*[.,]\s*(\d)(?!\d)|(?<![\d.,])(\d{1,2})[.,](\d)(?!\d)|f\s*/?\s*(\d)(\d)(?!\d)", text):
        a, b = next((m[k], m[k + 1]) for k in (1, 3, 5) if m[k] is not None)
        aperture, text = int(a) * 10 + int(b), text[: m.start()] + " " + text[m.end() :]
    if focal < 0 and (m := re.search(r"(?<![\d.,])(\d{2,3})(?![\d.,])", text)):
        focal, text = int(m[1]), text[: m.start()] + " " + text[m.end() :]
    return focal, aperture, text


def _glued(token: str) -> tuple[str, str, str]:
    """Word, number and suffix of a token that writes them as one, such as sky410rtk or kestrel3oopro."""
    suffix = next((x for x in SUFFIXES if token.endswith(x) and re.search(r"\d[oil]*$", token[: -len(x)])), "")
    rest = token[: len(token) - len(suffix)]
    m = re.search(r"\d[\doil]*", rest)
    if not m:
        return token, "", ""
    word, number, after = rest[: m.start()], m[0], rest[m.end() :]
    while word and len(number) < 3 and word[-1] in "oil":  # a look-alike in front
        word, number = word[:-1], word[-1] + number
    if len(number) > 3 and not number.isdigit() and number[:3].isdigit():  # letters behind
        number, after = number[:3], number[3:] + after
    return (word + " " + after).strip(), number.translate(_LOOKS), suffix


def _split(text: str) -> tuple[list[str], list[str], list[str]]:
    """Words, numbers and suffixes of a make or model text; look-alikes in numbers become digits."""
    words, numbers, suffixes = [], [], []
    text = _ORDINAL.sub(" ", re.sub(r"\([^()]*\)", " ", text))
    for token in re.findall(r"[^\W_]+", text):
        if token in SUFFIXES:
            suffixes.append(token)
        elif re.fullmatch(r"[\doil]+", token) and not re.search(r"\dii$", token) and (re.search(r"\d", token) or len(token) == 3):
            numbers.append(token.translate(_LOOKS))
        elif re.search(r"\d", token):
            word, number, suffix = _glued(token)
            words += word.split()
            numbers += [number] * bool(number)
            suffixes += [suffix] * bool(suffix)
        else:
            words.append(token)
    return words, [n for n in numbers if len(n) >= 2], suffixes


_LENS_TEXT = re.compile(r"\d\s*mm|f\s*/\s*\d|f\d[.,]?\d|(?<!\d)\d{1,2}[.,]\d(?!\d)")
_LENS_BEHIND = re.compile(r"(?:\bw/|\bwith\b|\+|,)\s*(?=.*(?:mm|f\s*/?\s*\d))")
_LENS_INSIDE = re.compile(r"(?:[^\W\d_]+\.?\s*)?\d{1,3}\s*mm(?:\s*f\s*/?\s*\d{1,2}[.,]?\d)?")


def read_value(make: str | None, model: str | None, lens: str | None) -> Value:
    make, model, lens = fold(make), fold(model), fold(lens)
    typed_make = [w for w in re.findall(r"[^\W\d_]+", make) if len(w) > 1]
    typed_make = list(dict.fromkeys([*typed_make, "".join(typed_make)])) if typed_make else []
    if not _LENS_TEXT.search(lens):  # the lens may stand in another field
        if _LENS_TEXT.search(make) and not _LENS_TEXT.search(model):
            make, model = model, make
        if m := _LENS_BEHIND.search(model):
            model, lens = model[: m.start()], model[m.end() :]
        elif m := _LENS_INSIDE.search(model):
            model, lens = f"{lens} {model[: m.start()]} {model[m.end() :]}", m[0]
    words, numbers, suffixes = _split(f"{make} {model}")
    focal, aperture, rest = _lens(lens)
    lens_words = [w for w in re.findall(r"[^\W\d_]+", rest) if len(w) > 2]
    keep = [w for w in dict.fromkeys(words) if len(w) > 1]
    return Value(keep, list(dict.fromkeys(lens_words)), " ".join(sorted(set(numbers))), " ".join(sorted(set(suffixes))), focal, aperture, typed_make)


_VALUE = "words array<string>, lens_words array<string>, number string, suffixes string, focal int, aperture int, make_words array<string>"


def _read(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` (with columns make, model, lens_model) and what its values say."""
    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = lambda c: [x if isinstance(x, str) else None for x in b[c]]
            v = [read_value(*x) for x in zip(*map(text, fields))]
            yield b.assign(**{n: [getattr(x, n) for x in v] for n in ("words", "lens_words", "number", "suffixes", "focal", "aperture", "make_words")})

    return df.mapInPandas(run, f"{ddl}, {_VALUE}")


def grams(word) -> F.Column:
    """Padded character 2-grams of a word and those that skip a character, each once: a slip of the pen breaks few of them."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    places = lambda n: F.sequence(F.lit(1), F.greatest(F.length(padded) - n, F.lit(1)))
    near = F.transform(places(1), lambda i: padded.substr(i, F.lit(2)))
    apart = F.transform(places(2), lambda i: F.concat(padded.substr(i, F.lit(1)), F.lit("_"), padded.substr(i + 2, F.lit(1))))
    return F.array_distinct(F.concat(near, apart))


def match_words(words: DataFrame, vocabulary: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(word, entry_word, cosine): for each word the vocabulary words with which its weighted cosine is at least ``least``.

    ``vocabulary`` is indexed with its openings: an abbreviation meets the opening of its length. Grams count by rarity in the index."""
    openings = F.transform(F.sequence(F.lit(SHORTEST_OPENING), F.greatest(F.length("entry_word"), F.lit(SHORTEST_OPENING))), lambda n: F.substring("entry_word", F.lit(1), n))
    alias = vocabulary.select("entry_word", F.explode(F.array_distinct(openings)).alias("alias"))
    posting = materialise(alias.select("entry_word", "alias", F.explode(grams(F.col("alias"))).alias("gram")))
    n = alias.count()
    weight = materialise(posting.groupBy("gram").agg(F.log1p(F.lit(float(max(n, 1))) / F.count("*")).alias("w")))
    posting = posting.join(broadcast_if_small(weight), "gram")
    norm = posting.groupBy("entry_word", "alias").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    index = materialise(posting.join(broadcast_if_small(norm), ["entry_word", "alias"]).select("gram", "entry_word", "alias", "norm"))
    unseen = F.lit(math.log1p(max(n, 1)))
    asked = words.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    asked = materialise(asked.join(broadcast_if_small(weight), "gram", "left").withColumn("w", F.coalesce("w", unseen)))
    own = asked.groupBy("word").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own"))
    dots = asked.join(broadcast_if_small(index), "gram").groupBy("word", "entry_word", "alias", "norm").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    cosine = dots.join(own, "word").select("word", "entry_word", (F.col("dot") / (F.col("norm") * F.col("own"))).alias("cosine"))
    return cosine.groupBy("word", "entry_word").agg(F.max("cosine").alias("cosine")).filter(F.col("cosine") >= least)


def _scored(typed: DataFrame, entries: DataFrame) -> DataFrame:
    """(value_id, entry, score) of the entries of each value that pass the exact check."""
    part = lambda c, name: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(name).alias("field")))
    family = F.filter("words", lambda w: ~F.array_contains("make_words", w))
    listed = F.explode(F.concat(part(F.col("make_words"), "make"), part(family, "family"), part(F.col("lens_words"), "lens"))).alias("x")
    vocab = entries.select("entry", listed).select("entry", F.col("x.w").alias("entry_word"), F.col("x.field").alias("field")).filter(F.length("entry_word") > 1).distinct()
    said = typed.select("value_id", F.explode(F.concat(part(F.col("words"), "body"), part(F.col("lens_words"), "lens"))).alias("x")).select("value_id", F.col("x.w").alias("word"), (F.col("x.field") == "lens").alias("of_lens"))
    hits = materialise(match_words(said.select("word").distinct(), vocab.select("entry_word").distinct()))
    e = entries.select("entry", F.col("number").alias("e_number"), F.col("suffixes").alias("e_suffixes"), F.col("focal").alias("e_focal"), F.col("aperture").alias("e_aperture"), (F.size("lens_words") > 0).alias("e_lens"))
    listed = materialise(vocab.join(broadcast_if_small(e), "entry"))
    v = materialise(said.join(typed.select("value_id", "number", "suffixes", "focal", "aperture"), "value_id"))
    # The number and the suffixes are part of the key wherever a number is named, so a word that all entries hold meets only those in question.
    body = v.filter("not of_lens").join(broadcast_if_small(hits), "word")
    numbered = body.filter("number <> ''").join(broadcast_if_small(listed.filter("field <> 'lens'")), (body["entry_word"] == listed["entry_word"]) & (body["number"] == F.col("e_number")) & (body["suffixes"] == F.col("e_suffixes")))
    sure = body.filter("number = ''").join(broadcast_if_small(listed.filter("field = 'family'").select("entry_word").distinct()), "entry_word", "left_semi").filter(F.col("cosine") >= SURE).select("value_id").distinct()
    bare = body.filter("number = ''").join(sure, "value_id", "left_semi")
    bare = bare.join(broadcast_if_small(listed.filter("field <> 'lens'")), (bare["entry_word"] == listed["entry_word"]) & (bare["suffixes"] == F.col("e_suffixes")))
    best = lambda f: F.max(F.when(F.col("field") == f, F.col("cosine")).otherwise(F.lit(0.0))).alias(f)
    pick = ["value_id", "number", "focal", "aperture", "entry", "e_lens", "e_focal", "e_aperture", "field", "cosine"]
    pairs = numbered.select(*pick).unionByName(bare.select(*pick)).filter("not e_lens or ((focal < 0 or focal = e_focal) and (aperture < 0 or aperture = e_aperture))")
    pairs = pairs.groupBy("value_id", "number", "entry").agg(best("make"), best("family")).filter((F.col("number") != "") | (F.col("family") >= SURE))
    glass = v.filter("of_lens").join(broadcast_if_small(hits), "word").select("value_id", "entry_word", "cosine")
    glass = glass.join(broadcast_if_small(vocab.filter("field = 'lens'")), "entry_word").groupBy("value_id", "entry").agg(F.max("cosine").alias("lens"))
    score = F.when(F.col("number") != "", (1.0 + F.col("make") + F.col("family")) / 3).otherwise((F.col("make") + F.col("family")) / 2)
    return pairs.join(glass, ["value_id", "entry"], "left").select("value_id", "entry", (score + F.coalesce("lens", F.lit(0.0)) / 3).alias("score"))


def map_values(df: DataFrame, key: str, reference: DataFrame, ref_key: str, fields: list[str]) -> DataFrame:
    """(key, ref_key, candidates, fields…): the entry meant by each key's value, -1 where none reaches the threshold or several are within the margin (``candidates`` tells how many)."""
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))).alias("v"))
    one = one.select(key, *(F.col(f"v.{f}").alias(f) for f in fields))
    typed = materialise(_read(one.select(*fields).distinct(), fields).withColumn("value_id", F.monotonically_increasing_id()))
    entries = reference.filter(F.col(ref_key).isNotNull()).groupBy(F.col(ref_key).alias("entry")).agg(F.min(F.struct(*(F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields))).alias("v"))
    entries = materialise(_read(entries.select("entry", *(F.col(f"v.{f}").alias(f) for f in fields)), fields))
    scored = _scored(typed, entries).filter(F.col("score") >= THRESHOLD)
    top = F.max("score").over(Window.partitionBy("value_id"))
    left = scored.withColumn("top", top).filter(F.col("score") > F.col("top") - MARGIN).groupBy("value_id").agg(F.count("*").alias("candidates"), F.min("entry").alias("entry"))
    resolved = typed.select("value_id", *fields).join(left, "value_id", "left")
    resolved = resolved.select(*fields, F.when(F.col("candidates") == 1, F.col("entry")).otherwise(F.lit(-1)).alias(ref_key), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return one.join(resolved, fields).select(key, ref_key, "candidates", *fields)
