"""Checks that need order or accounting: streams of numbers and signs, where extra and missing numbers come from, headings aligned by level."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import NARROW, WIDE, numbers
from .verification import CRITICAL

# Every dash that may stand for a minus sign, and what counts as a number (thousands only before three digits).
DASHES = "‐‑‒–—―−－﹣﹘˗➖⁃"
BODY = r"(?:(?:[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)"
NUMBER_TOKEN = rf"\(\s*-?{BODY}\s*%?\s*\)%?|(?<![0-9.])-?{BODY}%?|{BODY}%?"
# What stands for "none" between two values.
PLACEHOLDER = rf"(?<![\p{{L}}\p{{N}}/*…-])(?:[-/*…]+(?=-{BODY})|[-/*…]++(?![\p{{L}}\p{{N}}]))|(?<![\p{{L}}\p{{N}}.])(?:\.+(?=\.[0-9])|\.{{2,}}+(?![\p{{L}}\p{{N}}]))"


def folded(text: Column) -> Column:
    return F.translate(F.translate(F.coalesce(text, F.lit("")), WIDE, NARROW), DASHES, "-" * len(DASHES))


def stream(text: Column) -> Column:
    """The numbers, critical characters and placeholders of a text in reading order, numbers without spaces and thousands' commas.

    Not counted: the dashed lines of tables, list marks at the beginning of a line, lines of three or more dashes or dots, and dashes beside a letter or digit.
    """
    t = F.regexp_replace(folded(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)^(?=[^\n]*\|)(?=[^\n]*[-:])[ \t\f\r|:-]*$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:[-/*…]{3,}|\.{3,})[ \t]*$", "")
    t = F.regexp_replace(t, r"(?m)^([ \t]*)[-/*…](?=[ \t])", "$1 ")
    found = F.regexp_extract_all(t, F.lit(f"({NUMBER_TOKEN}|[{CRITICAL}]|{PLACEHOLDER})"), 1)
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s,]", ""), r"^(\(.*)\)%$", "$1%)")
    return F.transform(found, lambda x: F.when(x.rlike("[0-9]"), clean(x)).otherwise(x))


def stream_difference(texts: DataFrame, key: str, structured: str, source: str) -> DataFrame:
    """(key, n_structured, n_source, place, structured_token, source_token): the first place (from 1) at which the streams of two texts differ, and what stands there; null where they are equal.

    A multiset of numbers doesn't see two that changed places; the stream does. Row by row, without a shuffle; null texts are empty.
    """
    d = texts.select(key, stream(F.col(structured)).alias("a"), stream(F.col(source)).alias("b"))
    longest = F.greatest(F.size("a"), F.size("b"))
    differs = lambda x, y: ~x.eqNullSafe(y)
    marks = F.zip_with("a", "b", differs)  # the shorter side is filled with nulls, which no token is
    place = F.array_position(marks, True).cast("int")
    at = F.when((longest > 0) & (place > 0), place)
    return d.select(key, F.size("a").alias("n_structured"), F.size("b").alias("n_source"), at.alias("place"), F.get("a", at - 1).alias("structured_token"), F.get("b", at - 1).alias("source_token"))


# Accounting --------------------------------------------------------------------------------------------------------


def heal(text: Column) -> Column:
    """Spaces beside a decimal point or thousands' comma between digits are taken out."""
    return F.regexp_replace(text, r"(?<=[0-9])[ \t]*([.,])[ \t]*(?=[0-9])", "$1")


def accounted(texts: DataFrame, key: str, sides: list[Column], names: list[str], f: Callable[..., tuple]) -> DataFrame:
    """(key, a count per name): f of each row's lists of numbers, one list a side. Each row is judged where it is read: nothing is shuffled."""
    d = texts.select(key, *[c.alias(f"side{i}") for i, c in enumerate(sides)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f(*lists) for lists in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *counts], names=[key, *names])

    return d.mapInArrow(run, ", ".join([f"`{key}` {d.schema[0].dataType.simpleString()}", *[f"{n} long" for n in names]]))


def numbers_of(text: Column) -> Column:
    return numbers(F.coalesce(text, F.lit("")))


def dealt(amount: int, *has: int) -> list[int]:
    """An amount dealt in order: each takes what is left up to what it has; the last one is what stays."""
    out = []
    for h in has:
        out.append(min(amount, h))
        amount -= out[-1]
    return [*out, amount]


def value_key(token: Column) -> Column:
    """The value of a number without sign, brackets, per cent, commas, and zeros that don't count."""
    t = F.regexp_replace(F.regexp_replace(token, r"^[()%+-]+|[()%]+$", ""), ",", "")
    t = F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    t = F.regexp_replace(t, r"^0+(?=[0-9])", "")
    return F.when(t.startswith(".") | (t == ""), F.concat(F.lit("0"), t)).otherwise(t)


INVENTED = ["merge_expansion", "spacing_artifact", "image_ocr", "chart_title_year", "adjacent_page", "list_number_merge", "format_variant", "value_absent"]
#: A list's number that was joined to a year.
LIST_YEAR = re.compile(r"[0-9]{1,2}\.(?:19|20)[0-9]{2}")


def invented_numbers(texts: DataFrame, key: str) -> DataFrame:
    """(key, excess, a count per class of INVENTED) of texts(key, stored, unexpanded, layer, image, adjacent, title): where numbers come from that are stored more often than the text layer has them.

    Each number's surplus is dealt to the classes in order, the first that can take it: repeated by unfolding merged cells; gone once spaces within
    numbers are closed; in an image; in a chart's title; on a neighbouring page; a list number joined to a year; the same value in another form; nowhere. The classes add up to excess.
    """
    sides = [numbers_of(F.col(k)) for k in ("stored", "unexpanded", "layer", "image", "title", "adjacent")] + [numbers_of(heal(F.col("unexpanded")))]
    values = [F.transform(sides[i], value_key) for i in (1, 2)]
    return accounted(texts, key, [*sides, *values], ["excess", *INVENTED], invented)


def invented(stored: list, unexpanded: list, layer: list, image: list, title: list, adjacent: list, healed: list, values: list, known: list) -> tuple:
    value, known = dict(zip(unexpanded, values, strict=True)), set(known)
    stored, unexpanded, layer, image, title, adjacent, healed = map(Counter, (stored, unexpanded, layer, image, title, adjacent, healed))
    total = dict.fromkeys(INVENTED, 0)
    for x in stored | unexpanded:
        raw = max(unexpanded[x] - layer[x], 0)
        total["merge_expansion"] += max(stored[x] - layer[x] - raw, 0)
        plain = min(raw, max(healed[x] - layer[x], 0))
        total["spacing_artifact"] += raw - plain
        *parts, rest = dealt(plain, image[x], title[x], adjacent[x])
        for name, part in zip(("image_ocr", "chart_title_year", "adjacent_page"), parts, strict=True):
            total[name] += part
        if rest:
            total["list_number_merge" if LIST_YEAR.fullmatch(x) else "format_variant" if value[x] in known else "value_absent"] += rest
    return (sum(total.values()), *total.values())


def lost_numbers(texts: DataFrame, key: str) -> DataFrame:
    """(key, header_footer, chart, inside_table, other) of texts(key, layer, output, header, chart_text, table_words): where numbers went that the text layer has more often than the output.

    Each number's shortfall is dealt in order: to headers and footers, to charts, to words within tables, and what is left is other.
    """
    sides = [numbers_of(F.col(k)) for k in ("layer", "output", "header", "chart_text", "table_words")]
    return accounted(texts, key, sides, ["header_footer", "chart", "inside_table", "other"], lost)


def lost(layer: list, output: list, *places: list) -> tuple:
    n, has, places = Counter(layer), Counter(output), [Counter(p) for p in places]
    parts = [dealt(max(n[x] - has[x], 0), *[p[x] for p in places]) for x in n]
    return tuple(sum(p[i] for p in parts) for i in range(len(places) + 1))


#: Digits longer than this are searched one by one.
LONG = 64


def digit_runs(text: Column) -> Column:
    """The digits of each number of a text, decimal points and commas within closed up."""
    return F.transform(F.regexp_extract_all(heal(folded(text)), F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), 1), lambda x: F.regexp_replace(x, "[^0-9]", ""))


def within(asked: set[str], runs: set[str]) -> set[str]:
    """Those of asked that stand within a run. Those of one length are met by all pieces of that length, so numbers and runs aren't paired."""
    lengths, out = defaultdict(set), set()
    for x in asked:
        lengths[len(x)].add(x)
    for n, some in lengths.items():
        if n > LONG or len(some) == 1:
            out.update(x for x in some if any(x in r for r in runs))
        else:
            out.update(r[i : i + n] for r in runs for i in range(len(r) - n + 1) if r[i : i + n] in some)
    return out


def missing_numbers(texts: DataFrame, key: str) -> DataFrame:
    """(key, total, hit, figure, unexplained, decor, tokenization, absent) of texts(key, reference, candidate, layer, stripped, figure_text): what became of the reference's numbers.

    What the candidate lacks is dealt in order: numbers of stripped figures, numbers that the text layer has beyond the candidate, numbers of stripped
    headers; the rest is tokenization where its digits stand within a longer run of digits, else absent.
    """
    sides = [numbers_of(c) for c in (heal(F.col("reference")), *[F.col(k) for k in ("candidate", "layer", "stripped", "figure_text")])]
    runs = F.concat(*[digit_runs(F.col(k)) for k in ("layer", "stripped", "figure_text")])
    return accounted(texts, key, [*sides, runs], ["total", "hit", "figure", "unexplained", "decor", "tokenization", "absent"], missing)


def missing(reference: list, candidate: list, layer: list, stripped: list, figure: list, runs: list) -> tuple:
    n, has, layer, stripped, figure = map(Counter, (reference, candidate, layer, stripped, figure))
    parts = {x: dealt(n[x], has[x], figure[x], max(layer[x] - has[x], 0), stripped[x]) for x in n}
    digits = {x: re.sub("[^0-9]", "", x) for x, p in parts.items() if p[-1]}
    held = within(set(digits.values()), set(runs))
    split = sum(parts[x][-1] for x, d in digits.items() if d in held)
    hit, found, unexplained, decor, rest = (sum(p[i] for p in parts.values()) for i in range(5))
    return len(reference), hit, found, unexplained, decor, split, rest - split


# Headings ----------------------------------------------------------------------------------------------------------


def joined_titles(found: list[tuple[str, int]], known: set[str]) -> list[tuple[str, int]]:
    """found with neighbours of one level joined where only together they are a known title."""
    out: list[tuple[str, int]] = []
    queue = iter(found)
    held = next(queue, None)
    while held is not None:
        ahead = next(queue, None)
        if ahead is not None and held[1] == ahead[1] and not {held[0], ahead[0]} & known and held[0] + ahead[0] in known:
            held, ahead = (held[0] + ahead[0], held[1]), next(queue, None)
        out.append(held)
        held = ahead
    return out


def aligned(found: list[str], gold: list[str]) -> list[tuple[int, int]]:
    """Places (in found, in gold) that rise on both sides: each title of found takes its next place in gold, by search in that title's own places."""
    places = defaultdict(list)
    for j, title in enumerate(gold):
        places[title].append(j)
    out, least = [], 0
    for i, title in enumerate(found):
        k = bisect_left(places.get(title, []), least)
        if k < len(places.get(title, [])):
            out.append((i, places[title][k]))
            least = places[title][k] + 1
    return out


def heading_alignment(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, matched, n_found, n_gold, level_agree, level_total) of gold and found(key, ordinal, title, level), one row per document with headings on either side.

    Titles compare by their letters and digits. Two neighbours of one level count as one title where gold has them joined. matched counts titles as
    multisets. Of titles aligned in order, neighbours agree where the level rises, stays or falls on both sides alike. A document's headings are one row.
    """
    def listed(d: DataFrame, name: str) -> DataFrame:
        h = d.select(key, "ordinal", F.regexp_replace("title", r"[^\p{L}\p{N}]+", "").alias("title"), F.col("level").cast("int").alias("level")).filter("title <> ''")
        return h.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "title", "level"))).alias(name))

    both = listed(gold, "gold").join(listed(found, "found"), key, "full").select(key, "gold.title", F.col("gold.level").alias("gl"), F.col("found.title").alias("ft"), F.col("found.level").alias("fl"))
    kind = both.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = lambda x: (x > 0) - (x < 0)
        for b in batches:
            rows = []
            for _, gt, gl, ft, fl in zip(*[c.to_pylist() for c in b.columns], strict=True):
                g = list(zip(gt or [], gl or [], strict=True))
                f = joined_titles(list(zip(ft or [], fl or [], strict=True)), set(gt or []))
                count = defaultdict(int)
                for t, _ in g:
                    count[t] += 1
                matched = 0
                for t, _ in f:
                    matched += count[t] > 0
                    count[t] -= 1
                pairs = aligned([t for t, _ in f], [t for t, _ in g])
                agree = sum(sign(f[i2][1] - f[i1][1]) == sign(g[j2][1] - g[j1][1]) for (i1, j1), (i2, j2) in zip(pairs, pairs[1:], strict=False))
                rows.append((matched, len(f), len(g), agree, max(0, len(pairs) - 1)))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "matched", "n_found", "n_gold", "level_agree", "level_total"])

    return both.mapInArrow(run, f"`{key}` {kind}, matched long, n_found long, n_gold long, level_agree long, level_total long")
