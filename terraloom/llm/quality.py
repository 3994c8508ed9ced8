"""Per-document text statistics and how far a text is from the prose of its language.

Every line of a text gives a vector of statistics. Mean and covariance of prose are estimated for each language over the lines of all
documents, every line counting by its characters: a robust start from medians and quartiles, then rounds in which the lines within the
core give the next moments. The squared Mahalanobis distance of a line, and each statistic's share of it, tell whether it is prose;
what a line beyond the cutoff is follows from the groups of statistics by which it stands out (FORMS), each group by its own distance.
The form of a text is that of most of its characters. Statistics, distance and shares of a text are the means over its characters.

Lines that stand around a fixed share of all different contents (menus, notices) don't count as content at the head and tail of a text.
Copies of one content count once, so lines of a mirrored page are no menu; a text of nothing else is judged by all its lines. Language is
told from the text itself.

Defined results: null, empty and blank texts have no row; a repeated key counts once, and which of its texts holds is not defined unless
they are equal; lists have at least three items and tables two rows, fewer are taken for prose.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.runtime import materialise

FREQUENT_SHARE, FREQUENT_LEAST = 0.002, 5
LONGEST_FREQUENT = 200
NOTICE_LENGTH = 40
ROUNDS = 4

# Articles, pronouns, prepositions, conjunctions, auxiliaries and adverbs of time and degree of five languages.
COMMON = {
    "en": "a an the this that these those i you he she it we they me him her us them my your his its our their mine yours hers ours theirs who whom whose which what where when why how there here and or but nor so yet if because although though while since until unless than as of in on at by for with without about against between among into through during before after above below to from up down out off over under again then once near all any both each few more most other some such no not only own same too very just also even still already never ever always often now soon is am are was were be been being has have had having do does did will would shall should can could may might must ought isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't shouldn't it's it'll they'll he'll she'll i'll you'll we'll one many much every either neither another later earlier early late less little",
    "de": "der die das den dem des ein eine einer eines einem einen dieser diese dieses diesem diesen jener jene jenes ich du er sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen sich man mein dein sein ihre ihren ihrem ihres unser euer wer wen wem was welche welcher welches wo wohin woher wann warum wie und oder aber denn sondern wenn weil dass ob obwohl während bis bevor nachdem als damit seit in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter zwischen neben hinter für gegen ohne um durch wegen trotz ab nicht kein keine keiner keinen nur auch noch schon sehr so mehr viel viele alle alles etwas nichts niemand jemand hier dort da dann nun wieder immer nie oft bald bin bist ist sind seid war waren wäre habe hast hat haben hatte hatten hätte werde wird werden wurde wurden worden kann können konnte konnten muss müssen musste soll sollen sollte will wollen wollte darf dürfen mag doch also später früher früh spät wenig einmal",
    "es": "el la los las lo un una unos unas este esta estos estas ese esa esos esas aquel aquella yo tú él ella nosotros vosotros ellos ellas usted ustedes me te se nos os le les mi mis tu tus su sus nuestro nuestra quien quienes que qué cual cuál cuyo donde dónde cuando cuándo como cómo cuanto porque aunque si sino y e o u ni pero mientras pues a al ante bajo con contra de del desde en entre hacia hasta para por según sin sobre tras durante no sí ya muy más menos tan tanto mucho mucha muchos muchas poco todo toda todos todas otro otra algo alguien nada nadie nunca siempre también tampoco aquí allí ahí ahora antes después luego entonces es soy eres somos son era eran fue fueron ser sido siendo está estoy están estaba estaban estar he has ha hemos han había habían hay haber puede pueden debe deben cada uno tarde temprano pronto vez veces casi",
    "fr": "le la les l un une des du de d au aux ce cet cette ces je tu il elle nous vous ils elles on me te se moi toi lui leur leurs mon ma mes ton ta tes son sa ses notre nos votre vos qui que quoi dont où quand comment pourquoi quel quelle et ou mais donc or ni car si parce puisque lorsque comme à dans en sur sous avec sans pour par contre entre vers chez depuis pendant avant après devant derrière jusque ne pas plus moins très trop peu beaucoup bien aussi encore toujours jamais déjà rien personne tout toute tous toutes chaque quelque autre autres même y est suis es sommes êtes sont était étaient étions été être sera seront serait ai as a avons avez ont avait avaient avoir peut peuvent doit doivent faut c'est n'est d'un d'une qu'il qu'elle qu'on s'il l'on j'ai n'a n'avait n'ont d'être est-ce tard tôt bientôt ensuite puis presque fois",
    "ru": "я ты он она оно мы вы они меня тебя его её нас вас их мне тебе ему ей нам вам им мной собой себя мой моя твой свой наш ваш этот эта это эти этом этого этой тот та то те том того той кто что чего чему чем где куда откуда когда почему как какой который которая которые и а но или да ли если чтобы потому хотя пока в во на с со к ко у о об от до из за для при по под над через без между перед после около про не ни нет уже ещё еще очень более только также тоже так там тут здесь теперь потом всегда никогда никто ничего все всё весь вся другой сам есть был была было были быть будет будут может могут можно нужно надо бы же вот раз немного много чуть сейчас сразу опять раньше позже рано поздно",
}
COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_TELLING = {k: frozenset(w for w in COMMON[k] if len(w) > 1) for k in ("en", "de", "es", "fr")}
LANGUAGE_SHARE = 0.06

#: Statistics of a line with the least standard deviation each is given, so that one without spread in prose can't divide by zero and
#: wrapped lines of prose are near those of whole paragraphs.
FLOOR = {
    "log_length": 0.9, "log_words": 0.9, "word_length": 0.4, "symbol_ratio": 0.015, "digit_ratio": 0.02, "marked": 0.35, "punctuated": 0.3, "common_share": 0.08,
    "distinct_share": 0.1, "log_fields": 0.15, "log_values": 0.15, "inner_capitals": 0.03, "code_ratio": 0.01, "repeats": 0.1,
}
STATS = list(FLOOR)
CORE = 14.0  # squared distance within which lines give the moments
CUTOFF = 22.0  # squared distance beyond which a line isn't prose; chi-squared of 14 statistics at 92 %
#: What a line beyond the cutoff is: the first whose group of statistics is further from prose, by the squared distance in these alone,
#: than the limit. Values in a row can't be symbols many times as strange.
FORMS = [("junk", ["code_ratio"], 40.0), ("table", ["log_values"], 6.6), ("junk", ["word_length", "symbol_ratio", "distinct_share", "inner_capitals", "repeats", "digit_ratio"], 45.0), ("list", ["log_fields"], 6.6), ("list", ["log_length", "log_words", "punctuated"], 6.0)]
NOISE_PER_VALUE = 6.7
ALPHABET = 20  # different characters that any line of prose of some length has
VARIED = 15  # different words of it
NAMES = ["prose", "list", "table", "junk"]
#: Fewer items are no list, fewer rows no table.
LEAST = {"list": 3, "table": 2}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
LINE_BREAK = r"[\r\n\x0b\x0c\u0085\u2028\u2029]+"
_LINE = re.compile(LINE_BREAK)
_MARK = re.compile(r"\s*(?:[-*•·»>–—◦▪‣+]|\[[ xX]?\]|\(?\d{1,4}[.)]|\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|[a-zA-Z][.)])\s+")
_LINK = re.compile(r"\s*(?:[»>:–-]+\s*)?https?://\S+")
_FIELD_BREAK = re.compile(r"[|¦\t;]|,(?=[\d,-])|(?<=[\d,-]),(?=\S)|(?<=[^\s.!?])[ \u00a0\u2000-\u200a\u3000]{2,}(?=\S)")
_LETTER = re.compile(r"[^\W\d_]")
_NOT_DIGIT = re.compile(r"\D+")
_NUMBER = re.compile(r"\d+")
_NO_CODE = str.maketrans("", "", "{}=<>[]\\_&$@^~`")
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
BLANKS = " \t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
#: Characters that a one-byte charset shows for the second byte of a two-byte letter.
_BYTE = {(bytes([b]).decode("cp1252", "ignore") or chr(b)): b for b in range(0x80, 0xC0)} | {chr(b): b for b in range(0x80, 0xC0)}
_GARBLED = re.compile(f"[ÂÃ][{re.escape(''.join(_BYTE))}]")
_NOTICE = re.compile(r"(?:©|\(c\)|Â©|copyright\b)", re.I)
_END = frozenset(".!?…。！？\"”»")
_JA = re.compile(r"[぀-ヿ一-鿿]")
_HIRAGANA = re.compile(r"[぀-ゟ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def language(words: list[str], letters: int, japanese: int, cyrillic: int) -> str:
    """The language whose common words a text has most of; by script for Japanese and Russian. Too few common words tell nothing: then it
    is the first of the list, whose prose such texts are held against."""
    if japanese > 0.3 * letters:
        return "ja"
    if cyrillic > 0.4 * letters:
        return "ru"
    hits = {k: sum(map(_TELLING[k].__contains__, words)) for k in _TELLING}
    best = max(hits, key=hits.__getitem__)
    return best if hits[best] >= LANGUAGE_SHARE * len(words) else next(iter(_TELLING))


def line_key(s: str) -> str:
    """A line as it is counted over the corpus: long ones (notices) without their numbers, none with invisible characters."""
    s = _INVISIBLE.sub("", s)
    return _NUMBER.sub("0", s) if len(s) > NOTICE_LENGTH else s


def _mend(m: re.Match) -> str:
    return bytes([194 + (m[0][0] == "Ã"), _BYTE[m[0][1]]]).decode("utf-8")


def mend(text: str) -> str:
    """``text`` with accented letters that were decoded in the wrong one-byte charset put right; other garbling stays."""
    return _GARBLED.sub(_mend, text) if "Ã" in text or "Â" in text else text


def _lines(text: str) -> list[str]:
    return [x for x in map(str.strip, _LINE.split(text)) if x]


def _is_frequent(s: str, frequent) -> bool:
    return len(s) <= LONGEST_FREQUENT and line_key(s) in frequent


def _content(lines: list[str], frequent: frozenset[str]) -> list[int]:
    """The places of the lines that don't stand, frequent or a notice, at the head or tail; of all lines if nothing else is there."""
    outer = lambda x: _is_frequent(x, frequent) or _NOTICE.match(x)
    a, b = 0, len(lines)
    while a < b and outer(lines[a]):
        a += 1
    while b > a and outer(lines[b - 1]):
        b -= 1
    return [k for k in range(a, b) if not _NOTICE.match(lines[k])] or list(range(len(lines)))


def _plain(line: str) -> tuple[str, bool]:
    """A line without the mark of an item and the targets of links, and whether it had any."""
    m = _MARK.match(line)
    body = line[m.end() :] if m else line
    if "://" in body:
        return _LINK.sub("", body).strip() or line, True
    return body or line, m is not None


def measure(body: str, marked: bool, raw: list[str], common: frozenset[str], japanese: bool) -> tuple[float, ...]:
    """The statistics of a line in the order of STATS; ``raw`` are its words as written. Shares of few words or characters are drawn in."""
    n, count = len(body), max(1, len(raw))
    letters = sum(map(len, raw))
    digits = len(_NOT_DIGIT.sub("", body))
    symbols = max(0, n - letters - digits - (n - len("".join(body.split()))))
    fields = _FIELD_BREAK.split(body.strip("|¦ "))
    values = sum(not _LETTER.search(c) for c in fields) if len(fields) > 1 else 0
    if japanese:
        words, length, capitals = letters / 2, 5.0, 0
        shared, distinct = len(_HIRAGANA.findall(body)) / max(1, letters), min(1.0, len(set(body)) / min(n, VARIED))
    else:
        lower = list(map(str.lower, raw))
        words, length = len(raw), min((letters + 20) / (count + 4), 30.0)
        shared, distinct = sum(map(common.__contains__, lower)) / count, min(1.0, len(set(lower)) / min(count, VARIED))
        capitals = sum(len(w) > 1 and not w[1:].islower() for w in raw)
    return (
        math.log1p(n), math.log1p(words), length, symbols / (n + 20), digits / (n + 20), float(marked), float(body[-1] in _END), shared, distinct,
        math.log(len(fields)), math.log1p(values), capitals / (count + 2), (n - len(body.translate(_NO_CODE))) / (n + 20), math.log(min(n, ALPHABET) / min(len(set(body)), ALPHABET)),
    )


def describe(text: str, frequent: frozenset[str]) -> tuple[str, np.ndarray, tuple]:
    """Language, one row (characters, STATS…) for each line of content, and (words, mean word length, symbol ratio, share of lines ending in punctuation, share of common words)."""
    text = mend(text)
    lines = _lines(text)
    plain = [_plain(x) for x in lines]
    raw = [_WORD.findall(x) for x, _ in plain]
    every = [w.lower() for ws in raw for w in ws]
    lang = language(every, max(1, sum(map(len, every))), len(_JA.findall(text)), 0 if text.isascii() else len(_CYRILLIC.findall(text)))
    common = COMMON.get(lang, frozenset())
    use = _content(lines, frequent)
    table = np.array([(len(lines[k]), *measure(*plain[k], raw[k], common, lang == "ja")) for k in use], np.float32)
    words = [w for k in use for w in raw[k]]
    letters, size = sum(map(len, words)), sum(len(lines[k]) for k in use)
    dense = sum(len("".join(lines[k].split())) for k in use)
    shared = len(_HIRAGANA.findall(text)) / max(1, letters) if lang == "ja" else sum(w.lower() in common for w in words) / max(1, len(words))
    digits = sum(len(_NOT_DIGIT.sub("", lines[k])) for k in use)
    return lang, table, (len(words), letters / max(1, len(words)), max(0, dense - letters - digits) / max(1, size), sum(lines[k][-1] in _END for k in use) / len(use), shared)


WHOLE = ["words", "mean_word_length", "symbol_share", "punctuated_share", "common_words_share"]


def frequent_lines(docs: DataFrame, text: str = "text") -> frozenset[str]:
    """Trimmed lines that stand around at least FREQUENT_SHARE of all different contents; at most lines-per-document / FREQUENT_SHARE rows
    for each copy that a text has on average reach the driver."""
    least = max(FREQUENT_LEAST, math.ceil(FREQUENT_SHARE * docs.select(F.xxhash64(text)).distinct().count()))
    parts = F.transform(F.split(text, LINE_BREAK), lambda x: F.btrim(F.translate(x, INVISIBLE, ""), F.lit(BLANKS)))
    line = F.col("line")
    lines = docs.select(F.explode(F.array_distinct(parts)).alias("line")).filter((F.length(line) > 0) & (F.length(line) <= LONGEST_FREQUENT))
    lines = lines.select(F.when(F.length(line) > NOTICE_LENGTH, F.regexp_replace(line, r"\d+", "0")).otherwise(line).alias("line"))
    often = sorted(r.line for r in lines.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect())
    places = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(often)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = places.value
        for b in batches:
            found, contents = [], []
            for t in b[text]:
                known, rest, size = set(), [], 0
                for x in _lines(mend(t)):
                    if _is_frequent(x, at):
                        known.add(at[line_key(x)])
                        size += len(x)
                    elif not _NOTICE.match(x):
                        rest.append(line_key(x))
                # Less than the frequent lines themselves is no content they stand around: copies may differ in a line.
                if known and sum(map(len, rest)) >= size:
                    digest = hashlib.blake2b("\n".join(rest).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    found += known
                    contents += [int.from_bytes(digest, "big", signed=True)] * len(known)
            yield pd.DataFrame({"place": np.array(found, np.int32), "content": np.array(contents, np.int64)})

    around = docs.select(text).mapInPandas(run, "place int, content bigint").distinct().groupBy("place").agg(F.count("*").alias("n"))
    return frozenset(often[r.place] for r in around.filter(F.col("n") >= least).collect())


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, WHOLE…, lines) of every text that isn't blank; ``lines`` holds the rows of :func:`describe` as 4-byte floats."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").rlike(r"[^\s\u00a0\u0085\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"))
    frequent = df.sparkSession.sparkContext.broadcast(frequent_lines(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"]):
                lang, table, whole = describe(t, frequent.value)
                rows.append((k, lang, *whole, table.tobytes()))
            yield pd.DataFrame(rows, columns=["key", "lang", *WHOLE, "lines"])

    schema = f"key {dict(df.dtypes)[key]}, lang string, words bigint, " + ", ".join(f"{s} double" for s in WHOLE[1:]) + ", lines binary"
    return docs.mapInPandas(run, schema)


def _tables(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all texts of a batch, and the text each belongs to."""
    width = 4 * (len(STATS) + 1)
    sizes = np.array([len(x) // width for x in b["lines"]], int)
    return np.frombuffer(b"".join(b["lines"]), np.float32).reshape(-1, len(STATS) + 1).astype(float), np.repeat(np.arange(len(b)), sizes)


#: Digits behind the point to which values are rounded where quartiles are counted.
_STEP = 0.02


def _quartiles(different: DataFrame) -> dict[str, np.ndarray]:
    """Quartiles of every statistic by language, each line counting by its characters, from counts of rounded values (at most
    range / _STEP rows for each statistic and language reach the driver)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, owner = _tables(b)
            lang = b["lang"].to_numpy()[owner]
            parts = [pd.DataFrame({"lang": lang, "stat": j, "value": np.round(rows[:, j + 1] / _STEP).astype(int), "n": rows[:, 0]}) for j in range(len(STATS))]
            yield pd.concat(parts).groupby(["lang", "stat", "value"], as_index=False)["n"].sum()

    counts = different.mapInPandas(run, "lang string, stat int, value int, n double").groupBy("lang", "stat", "value").agg(F.sum("n").alias("n")).toPandas()
    out: dict[str, np.ndarray] = {}
    for (lang, j), g in counts.sort_values("value").groupby(["lang", "stat"]):
        at = np.searchsorted(np.cumsum(g["n"].to_numpy()), np.array([0.25, 0.5, 0.75]) * g["n"].sum())
        out.setdefault(lang, np.zeros((len(STATS), 3)))[j] = g["value"].to_numpy()[np.minimum(at, len(g) - 1)] * _STEP
    return out


def _parts(rows: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Each statistic's share z_i (P z)_i of the squared distance of each row."""
    z = rows[:, 1:] - mean
    return z * (z @ precision)


def prose_moments(different: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Robust mean and covariance of prose for each language, from the lines of all different texts. A round brings one row for each
    language and moment to the driver."""
    spark, k = different.sparkSession, len(STATS)
    floor = np.diag(np.square(list(FLOOR.values())))
    moments = {lang: (q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2) + floor) for lang, q in _quartiles(different).items()}
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast({lang: (m, np.linalg.inv(c)) for lang, (m, c) in moments.items()})

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                rows, owner = _tables(b)
                lang = b["lang"].to_numpy()[owner]
                for name in set(lang):
                    mean, precision = shared.value[name]
                    x = rows[lang == name]
                    x = x[_parts(x, mean, precision).sum(1) <= CORE]
                    w, z = x[:, :1], x[:, 1:] - mean
                    sums[name] = sums.get(name, 0) + np.concatenate([[len(x), w.sum()], (w * z).sum(0), ((w * z).T @ z).ravel()])
            out = [(name, i, v) for name, s in sums.items() for i, v in enumerate(s)]
            yield pd.DataFrame(out, columns=["lang", "i", "v"])

        got = different.mapInPandas(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
        for name, g in got.groupby("lang"):
            v = g.sort_values("i")["v"].to_numpy()
            if v[0] < 2 * k:
                continue
            shift, second = v[2 : 2 + k] / v[1], v[2 + k :].reshape(k, k) / v[1]
            moments[name] = moments[name][0] + shift, second - np.outer(shift, shift) + floor
    return moments


def line_forms(rows: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(form as a place in NAMES, shares of the squared distance) of each row."""
    parts = _parts(rows, mean, np.linalg.inv(covariance))
    z = rows[:, 1:] - mean
    own = []
    for _, group, _ in FORMS:
        i = [STATS.index(s) for s in group]
        own.append(np.einsum("ij,jk,ik->i", z[:, i], np.linalg.inv(covariance[np.ix_(i, i)]), z[:, i]))
    stands = [d > limit for d, (_, _, limit) in zip(own, FORMS)]
    stands[1] &= own[2] < NOISE_PER_VALUE * own[1]
    near = parts.sum(1) <= CUTOFF
    form = np.select([near, *stands], [0, *(NAMES.index(f) for f, _, _ in FORMS)], NAMES.index("junk"))
    return form, parts


def outlierness(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, WHOLE…, STATS…, d_<statistic>…, distance2, form) of every text that isn't blank; form is null for prose."""
    stats = materialise(statistics(df, key, text))
    different = materialise(stats.select("lang", "lines").distinct())  # copies of a page aren't the prose of their language
    shared = df.sparkSession.sparkContext.broadcast(prose_moments(different))
    names = [*STATS, *(f"d_{s}" for s in STATS), "distance2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, owner = _tables(b)
            form, parts = np.zeros(len(rows), int), np.zeros((len(rows), len(STATS)))
            lang = b["lang"].to_numpy()[owner]
            for name in set(lang):
                at = lang == name
                form[at], parts[at] = line_forms(rows[at], *shared.value[name])
            size, items = np.zeros((len(b), len(NAMES))), np.zeros((len(b), len(NAMES)))
            np.add.at(size, (owner, form), rows[:, 0])
            # Fields that stand side by side are items of their own.
            np.add.at(items, (owner, form), np.where(form == NAMES.index("list"), np.exp(rows[:, 1 + STATS.index("log_fields")]), 1.0))
            for f, least in LEAST.items():
                few = items[:, NAMES.index(f)] < least - 1e-3
                size[few, 0] += size[few, NAMES.index(f)]
                size[few, NAMES.index(f)] = 0
            sums = np.zeros((len(b), 2 * len(STATS)))
            np.add.at(sums, owner, rows[:, :1] * np.concatenate([rows[:, 1:], parts], 1))
            sums /= np.maximum(size.sum(1), 1)[:, None]
            most = size.argmax(1)
            out = pd.DataFrame(np.concatenate([sums, sums[:, len(STATS) :].sum(1)[:, None]], 1), columns=names)
            yield b.drop(columns="lines").reset_index(drop=True).join(out).assign(form=[NAMES[m] if m else None for m in most])

    schema = ", ".join(f"{n} {t}" for n, t in stats.drop("lines").dtypes) + ", " + ", ".join(f"{n} double" for n in names) + ", form string"
    return stats.mapInPandas(run, schema).dropDuplicates(["key"]).withColumnRenamed("key", key)
