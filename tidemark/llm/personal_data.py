"""Personal data: fixed rules, and boosted trees that select from what high-recall generators propose. DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written

# The kinds, in the order in which spans that start together are listed.
KINDS = ["email", "ip", "card", "phone"]
# The base patterns, written so that they take time in proportion to the text: a match starts where a run of its
# first characters starts or where the last match ended, and takes what it must take without going back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT = r"\x20?[\[({<]\x20?(?i:at)\x20?[\])}>]\x20?|\x20(?i:at)\x20|\x20@\x20?|@\x20|＠"
DOT = r"\x20?[\[({<]\x20?(?i:dot|\.)\x20?[\])}>]\x20?|\x20(?i:dot)\x20|\.|．"
LOCAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+"
#: Generators: (kind, pattern) of what may be personal data. They propose too much, and spans of several may overlap.
LOOSE = {
    "email_spelled": ("email", rf"{LOCAL}(?:{AT})[A-Za-z0-9-]{{1,63}}+(?:(?:{DOT})[A-Za-z0-9-]{{2,63}}+){{1,8}}"),
    "email_spaced": ("email", rf"{LOCAL}(?:{AT}|@)[A-Za-z0-9-]{{1,63}}+(?:(?:{DOT}|\x20?\.\x20?)[A-Za-z0-9-]{{2,63}}+){{1,8}}"),
    "email_letters": ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)++"),
    "ip_spelled": ("ip", rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:(?:{DOT}|\x20\.\x20|\.\x20)[0-9]{{1,3}}){{3}}(?![0-9])"),
    "ip_six": ("ip", r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])"),
    "card_plain": ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "card_grouped": ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/ -]{1,3}[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[\x20._/ -]{1,3}[0-9]{6}[\x20._/ -]{1,3}[0-9]{5}(?![0-9])"),
    "phone_grouped": ("phone", r"(?<![0-9A-Za-z.+])(?:(?:\+|00)[0-9]{1,3}[\x20./-]?|1[\x20./-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20./-])[0-9]{3}[\x20./-][0-9]{4}(?![0-9])"),
    "phone_any": ("phone", r"(?<![0-9A-Za-z.+/-])(?:\+|00)?[0-9]{1,4}(?:[\x20./()-]{1,2}[0-9]{2,4}){2,5}(?![0-9A-Za-z])"),
}
RULES = {**{k: (k, p) for k, p in BASE.items()}, **LOOSE}
#: Characters of a generator's context on each side of a span.
CONTEXT = 24
#: A threshold is the least score above which at least this share of the calibration's spans are true.
PRECISION = 0.99
NO_ID = -(1 << 63)
DOC = ["i", "h"]


def plausible_text(rule: str, text: Column) -> Column:
    """False where a text can't hold a match, found by looking for one character or two."""
    spelled_at = r"(?i)[\x20\[({<]at[\x20\])}>]|＠"
    return {
        "email": text.contains("@"), "email_letters": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"),
        "email_spelled": text.contains("@") | text.rlike(spelled_at), "email_spaced": text.contains("@") | text.rlike(spelled_at), "ip_six": text.rlike(r":[0-9A-Fa-f]{1,4}:"), "card_plain": text.rlike(r"[0-9]{13}"),
    }.get(rule, text.rlike(r"[0-9][0-9 ./_() -]{0,3}[0-9]") if rule != "ip_spelled" else text.rlike(r"(?i)[0-9](?:\.|．|\x20?[\[({<]|\x20dot\x20|\x20\.)"))


def proposals(texts: DataFrame, keys: list[str], rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, rule, k, skip, match, before, whole): every rule's matches in a column text, in order, by one pass over the rows.

    A pattern is sought behind a lazy gap, so the pieces of a text (gap and match) add up to its length: skip is the gap's. A rule
    gives one more row, without a match, for what follows its last one; whole is the head of gap and match, for the context of the match before.
    """
    nothing = F.array().cast("array<struct<rule:string,k:int,skip:bigint,match:string,before:string,whole:string>>")

    def pieces(rule: str, pattern: str) -> Column:
        part = lambda n: F.regexp_extract_all("text", F.lit(f"(?s)(.*?)(?:({pattern})|\\z)"), F.lit(n))
        both = F.zip_with(part(1), part(2), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        row = lambda x, k: F.struct(F.lit(rule).alias("rule"), k.alias("k"), F.length(x["gap"]).cast("long").alias("skip"), x["match"].alias("match"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(F.concat(x["gap"], x["match"]), F.lit(CONTEXT)).alias("whole"))
        return F.when(plausible_text(rule, F.col("text")) & F.col("text").rlike(pattern), F.transform(both, row)).otherwise(nothing)

    found = [pieces(rule, pattern) for rule, (_, pattern) in rules.items()]
    end = F.array(F.struct(F.lit("").alias("rule"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("skip"), F.lit("").alias("match"), F.lit("").alias("before"), F.lit("").alias("whole")))
    return texts.select(*keys, F.inline(F.concat(end, *found)))


def located(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, kind, start, end, match, before, after) of proposals: places by running sums of the pieces, in code points, the end exclusive."""
    w = Window.partitionBy(*keys, "rule").orderBy("k")
    size = F.length("match").cast("long")
    kind = F.element_at(F.create_map(*[F.lit(x) for r, (k, _) in RULES.items() for x in (r, k)]), F.col("rule"))
    out = rows.filter("rule <> ''").withColumns({"end": F.sum(F.col("skip") + size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.coalesce(F.lead("whole").over(w), F.lit(""))})
    return out.filter("match <> ''").select(*keys, "rule", kind.alias("kind"), (F.col("end") - size).alias("start"), "end", "match", "before", "after")


def digits(c: str = "match") -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def octets(c: str = "match") -> Column:
    """Four runs of digits of at most 255 each."""
    octet = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return F.regexp_replace(c, "[^0-9]+", ".").rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def holds() -> Column:
    """Whether a match of a base pattern is a base span."""
    n = F.length(digits())
    return F.when(F.col("rule") == "email", True).when(F.col("rule") == "ip", octets()).when(F.col("rule") == "card", n.between(14, 19) & luhn(digits())).when(F.col("rule") == "phone", n.between(10, 15)).otherwise(False)


def with_overlaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans with base (a base span) and touches (a proposal that shares a place with a base span), by running bounds over each text's spans in order."""
    s = spans.withColumn("base", holds()).filter(F.col("base") | ~F.col("rule").isin(KINDS))
    ahead = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)  # a frame that grows: one to the end would be read anew for each row
    left = F.max(F.when(F.col("base"), F.col("end"))).over(ahead)
    right = F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    return s.withColumns({"left": left, "right": right}).withColumn("touches", ~F.col("base") & (F.coalesce(F.col("left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("right") < F.col("end"), F.lit(False)))).drop("left", "right")


def features() -> dict[str, Column]:
    """What the trees see of a proposal: its format, and its context on both sides."""
    m, b, a = F.col("match"), F.col("before"), F.col("after")
    d = digits()
    runs = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    sizes = F.transform(runs, lambda x: F.length(x))
    count = lambda pattern: F.length(F.regexp_replace(m, f"[^{pattern}]", ""))
    beside = lambda c: F.when(c == "", 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"[=\"':/_#]"), 3).when(c.rlike(r"\s"), 0).otherwise(4)
    label = F.regexp_extract(m, r"([\p{L}\p{N}-]+)$", 1)
    names = {"email": r"mail|contact|write|reach", "ip": r"\bip\b|host|server|addr|login|ping", "card": r"card|visa|amex|master|credit|\bpay", "phone": r"tel\b|phone|call|mobile|cell|fax|dial"}
    named = F.lit(False)
    for k, words in names.items():
        named = named | ((F.col("kind") == k) & b.rlike(f"(?i){words}"))
    f = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "chars": F.length(m), "digits": F.length(d), "letters": count(r"\p{L}"), "spaces": count(" "), "dots": count("."), "dashes": count(r"\-"), "slashes": count("/"), "colons": count(":"), "brackets": count(r"\[\](){}<>"),
        "runs": F.size(runs), "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)), "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), "last": F.coalesce(F.element_at(F.when(F.size(sizes) > 0, sizes), -1), F.lit(0)), "leading": F.when(d != "", F.left(d, F.lit(1)).cast("int")).otherwise(-1),
        "luhn": luhn(F.when(d == "", F.lit("1")).otherwise(d)), "octets": octets(), "abroad": m.rlike(r"^(?:\+|00)"), "at_sign": m.rlike("[@＠]"), "spelled_at": m.rlike(r"(?i)\x20at\x20"), "bracket_at": m.rlike(r"(?i)[\[({<]\x20?at"), "spelled_dot": m.rlike(r"(?i)\bdot\b"),
        "sentence": m.rlike(r"\.\x20?\p{Lu}"), "wide_dot": m.rlike(r"\.\x20"), "label": F.length(label), "label_lower": label.rlike(r"^\p{Ll}{2,24}$"), "hex": m.rlike("[a-fA-F]"), "date": m.rlike(r"^(?:(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)?[0-9]{2})$"),
        "year": m.rlike("^(?:19|20)[0-9]{2}[^0-9]"), "ten": m.rlike(r"(?:^|[^0-9])[0-9]{3}[^0-9]{1,2}[0-9]{3}[^0-9]{1,2}[0-9]{4}$"), "fours": m.rlike(r"^[0-9]{4}[^0-9]+[0-9]{4}[^0-9]+[0-9]{4}[^0-9]+[0-9]{4}$"), "behind": beside(F.right(b, F.lit(1))), "ahead": beside(F.left(a, F.lit(1))), "named": named,
    }
    return {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in f.items()}


def disguises() -> Column:
    """array<struct<text, start, end>>: a base span as people write it to get past a filter, or such that what stands beside it does. start and end are within text."""
    m, d = F.col("match"), digits()
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    # addresses of one corpus may all be made alike: others without digits, of two labels and of other endings teach what an address is
    lettered = F.translate(local, "0123456789", "etaoinshrd")
    ending = lambda k: F.element_at(F.array(*map(F.lit, ["com", "org", "net", "de", "fr", "es", "info", "eu"])), F.pmod(F.xxhash64(m, F.lit(k)), F.lit(8)).cast("int") + 1)
    short = lambda by, k: F.concat(F.translate(F.split_part(domain, F.lit("."), F.lit(1)), "0123456789", "lmbcdrtswn"), F.lit(by), ending(k))
    with_dots = lambda by: F.array_join(F.split(domain, r"\."), by)
    four = lambda by: F.array_join(F.array(*[F.substr(d, F.lit(k), F.lit(4)) for k in (1, 5, 9, 13)]), by)
    ten, country = F.right(d, F.lit(10)), F.left(d, F.length(d) - 10)
    x, y, z = F.left(ten, F.lit(3)), F.substr(ten, F.lit(4), F.lit(3)), F.right(ten, F.lit(4))
    ip = F.split(m, r"\.")
    h = F.md5(m)
    group = lambda k: F.substr(h, F.lit(4 * k + 1), F.lit(4))
    ways = {
        "email": [F.concat(local, F.lit(" (at) "), domain), F.concat(local, F.lit("[at]"), with_dots("[dot]")), F.concat(local, F.lit(" at "), with_dots(" dot ")), F.concat(local, F.lit(" @ "), domain), F.concat(local, F.lit(" AT "), with_dots(" DOT ")), F.concat(F.translate(local, "aeionsc", "áéíóñßç"), F.lit("ö@"), domain), F.concat(local, F.lit("{at}"), domain), F.concat(local, F.lit("@ "), with_dots(" . ")), F.concat(lettered, F.lit(" (at) "), short(".", 1)), F.concat(lettered, F.lit(" [at] "), short(" [dot] ", 2)), F.concat(lettered, F.lit(" at "), short(" dot ", 3)), F.concat(lettered, F.lit(" @ "), short(".", 4)), F.concat(F.regexp_replace(lettered, "[._%+-]", ""), F.lit("(at)"), short("(dot)", 5)), F.concat(F.translate(lettered, "aeionsc", "áéíóñßç"), F.lit("ü@"), short(".", 6)), F.concat(F.translate(lettered, "aeionsc", "áéíóñßç"), F.lit("@"), F.translate(F.split_part(domain, F.lit("."), F.lit(1)), "aeo0123456789", "äéölmbcdrtswn"), F.lit("."), ending(7)), F.concat(F.regexp_replace(lettered, "[._%+-]", ""), F.lit(" at "), with_dots(" dot "))],
        "ip": [F.array_join(ip, "[.]"), F.array_join(ip, " . "), F.array_join(ip, " dot "), F.array_join(ip, "(.)"), F.array_join(ip, "[dot]"), F.array_join(ip, ". "), F.concat_ws(":", *map(group, range(8))), F.concat(F.lit("fe80::"), F.concat_ws(":", *map(group, range(4)))), F.concat(F.lit("2001:db8:"), F.concat_ws(":", *map(group, range(3))), F.lit("::1"))],
        "card": [F.when(F.length(d) == 16, four(by)) for by in (".", "/", "  ", "_", " - ", " ")] + [F.when(F.length(d) == 15, F.concat_ws(by, F.left(d, F.lit(4)), F.substr(d, F.lit(5), F.lit(6)), F.right(d, F.lit(5)))) for by in (".", "/", "  ")] + [d],
        "phone": [F.concat(F.lit("("), x, F.lit(") "), y, F.lit("-"), z), F.concat_ws("-", x, y, z), F.concat_ws(".", x, y, z), F.concat_ws(" ", x, y, z), F.concat_ws("-", F.lit("1"), x, y, z), F.concat(F.lit("00"), F.concat_ws(" ", country, x, y, z)), F.concat_ws("/", x, y, z), F.concat(F.lit("+"), F.concat_ws("/", country, x, y, z)), F.concat(F.lit("("), x, F.lit(")"), y, F.lit("-"), z)],
    }
    out = F.array().cast("array<struct<head:string,text:string>>")
    for kind, ws in ways.items():
        head = lambda k, kind=kind: F.lit({"card": "42 ", "phone": "4711 "}.get(kind, "") if k % 4 == 3 else "")
        plain = [F.struct(head(k).alias("head"), w.alias("text")) for k, w in enumerate(ws)] + ([F.struct(F.lit(f"{n} ").alias("head"), d.alias("text")) for n in (1, 12, 203)] if kind == "card" else [])
        out = F.when(F.col("kind") == kind, F.array(*plain)).otherwise(out)
    return F.filter(out, lambda s: s["text"].isNotNull() & (s["text"] != ""))


def decoys() -> Column:
    """array<string> of what isn't personal data but looks like the kind of the span that it takes the place of; digits come from the span."""
    h = F.regexp_replace(F.concat(F.md5("match"), F.md5(F.concat("match", F.lit("+")))), "[a-f]", "7")
    cut = lambda k, n: F.substr(h, F.lit(k), F.lit(n))
    small = lambda k, n, least=0: (F.pmod(F.xxhash64("match", F.lit(k)), F.lit(n)) + least).cast("string")
    two = lambda c: F.lpad(c, 2, "0")
    day = lambda by: F.concat_ws(by, F.concat(F.lit("20"), two(small(1, 30))), two(small(2, 12, 1)), two(small(3, 28, 1)))
    wrong = F.concat(F.left(digits(), F.length(digits()) - 1), F.pmod(F.right(digits(), F.lit(1)).cast("int") + small(4, 9, 1).cast("int"), F.lit(10)).cast("string"))
    wrongs = [F.array_join(F.array(*[F.substr(wrong, F.lit(k), F.lit(4)) for k in (1, 5, 9, 13)]), by) for by in (".", "/", "  ", "_")]
    word = lambda k: F.element_at(F.split(F.concat(F.lit("it the them here once more "), F.regexp_replace(F.concat("before", F.lit(" "), "after"), r"[^\p{L}]+", " ")), " +"), F.pmod(F.xxhash64("match", F.lit(k)), F.lit(6)).cast("int") + 1)
    return (
        F.when(F.col("kind") == "email", F.array(F.concat(word(1), F.lit(" at "), word(2), F.lit(". "), F.initcap(word(3))), F.concat(word(1), F.lit(" at "), word(2), F.lit("."), word(3)), F.concat(cut(1, 1), F.lit(" @ "), cut(2, 1), F.lit("."), cut(3, 2)), F.concat(word(4), F.lit(" @ "), cut(4, 2), F.lit(".50 each")), F.concat(word(1), F.lit(" at "), cut(5, 2), F.lit("."), cut(7, 2)), F.concat(word(5), F.lit(" at "), word(6), F.lit(" . "), word(7))))
        .when(F.col("kind") == "ip", F.array(F.concat_ws("[.]", small(1, 600, 256), small(2, 200), small(3, 200), small(4, 200)), F.concat_ws(" . ", small(1, 200), small(2, 600, 256), small(3, 200), small(4, 200)), F.concat_ws(":", two(small(5, 24)), two(small(6, 60)), two(small(7, 60))), F.concat_ws(". ", small(1, 9), small(2, 900, 100), small(3, 900, 100), small(4, 9)), F.concat_ws(":", small(8, 9, 1), small(9, 9, 1), small(10, 9, 1)), F.concat_ws(":", small(8, 99), two(small(9, 60)), two(small(10, 60)), two(small(11, 99)))))
        .when(F.col("kind") == "card", F.array(wrong, *wrongs, F.concat(F.lit("978"), cut(1, 10)), F.concat(F.lit("20"), two(small(1, 30)), two(small(2, 12, 1)), two(small(3, 28, 1)), two(small(5, 24)), two(small(6, 60)), two(small(7, 60))), F.concat(F.lit("0000"), cut(1, 12))))
        .otherwise(F.array(day("-"), day("/"), day("."), day(" "), F.concat_ws("-", F.lit("978"), small(1, 9), cut(1, 2), cut(3, 6), small(2, 9)), F.concat_ws(" ", cut(1, 2), cut(3, 2), cut(5, 2)), F.concat_ws("-", F.concat(F.lit("19"), cut(1, 2)), F.concat(F.lit("20"), cut(3, 2)), cut(5, 2)), F.concat_ws(".", cut(1, 3), cut(4, 3), cut(7, 3)), F.concat_ws("/", cut(1, 2), cut(3, 4), cut(7, 2)), F.concat_ws(" ", cut(1, 4), cut(5, 4), cut(9, 4), cut(13, 4)), F.concat_ws(" ", cut(1, 3), cut(4, 3), cut(7, 3))))
    )


def examples(spans: DataFrame, folder: str) -> DataFrame:
    """(proposals' columns, y, fold, times): labelled proposals from all base spans, with how often each occurs. fold 1 is for calibration.

    True are the proposals that cover a base span, as it stands or disguised, exactly; false those that miss a disguised one's bounds, those
    that meet a decoy in a span's place, and the corpus's own that no format allows. Proposals of the corpus that might be true aren't used.
    """
    draw = lambda of: F.pmod(F.xxhash64(F.lit(of), *DOC, "start", "kind"), F.lit(1 << 30)) / (1 << 30)
    base = spans.filter("base").withColumn("fold", (draw(17) < 1 / 3).cast("int")).groupBy("kind", "match", "before", "after", "fold").agg(F.count("*").cast("double").alias("times"))
    own = F.array(F.struct(F.lit("").alias("head"), F.col("match").alias("text"), F.lit(1).alias("y")))
    true = F.transform(disguises(), lambda s: F.struct(s["head"].alias("head"), s["text"].alias("text"), F.lit(1).alias("y")))
    false = F.transform(decoys(), lambda s: F.struct(F.lit("").alias("head"), s.alias("text"), F.lit(0).alias("y")))
    snippets = base.select("kind", "fold", "times", "before", "after", F.posexplode(F.concat(own, true, false)).alias("way", "s"))
    snippets = snippets.filter("s.text is not null").select(F.monotonically_increasing_id().alias("n"), F.col("kind").alias("of"), "fold", "times", F.col("s.y").alias("planted"), F.length(F.concat("before", "s.head")).cast("long").alias("from"), F.length("s.text").cast("long").alias("size"), F.concat("before", "s.head", "s.text", "after").alias("text"))
    keys = ["n", "of", "fold", "times", "planted", "from", "size"]
    spark = spans.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # small files, much work a row
    snippets = written(snippets, "snippets", folder).repartition(tasks, "n")
    found = located(proposals(snippets, keys, LOOSE), keys)
    exact = (F.col("start") == F.col("from")) & (F.col("end") == F.col("from") + F.col("size")) & (F.col("kind") == F.col("of"))
    meets = (F.col("start") < F.col("from") + F.col("size")) & (F.col("end") > F.col("from"))
    columns = ["rule", "kind", "match", "before", "after"]
    chance = (F.col("kind") == "card") & luhn(digits())  # a decoy that passes the check by chance is no example of a wrong number
    made = found.filter(meets & ((exact & (F.col("planted") == 1)) | ~F.coalesce(chance, F.lit(False)))).select(*columns, F.when(exact & (F.col("planted") == 1), 1).otherwise(0).alias("y"), "fold", "times")
    never = F.when(F.col("kind") == "card", ~luhn(digits())).when(F.col("rule") == "ip_spelled", ~octets()).when(F.col("kind") == "email", F.col("match").rlike(r"(?i)\x20at\x20") & ~F.col("match").rlike(r"(?i)[0-9]|\bdot\b"))
    never = never.when(F.col("kind") == "phone", F.col("before").rlike(r"[\p{L}=\"':/_#.-]$") | F.col("after").rlike(r"^[\p{L}=\"':/_#-]")).otherwise(False)
    plain = spans.filter(~F.col("base") & ~F.col("touches") & never)
    plain = plain.select(*columns, F.lit(0).alias("y"), (draw(23) < 1 / 3).cast("int").alias("fold"), F.lit(1.0).alias("times"))
    return made.unionByName(plain)


def fitted(labelled: DataFrame, folder: str, precision: float) -> tuple | None:
    """(trees, thresholds by kind): boosted on fold 0, equal feature vectors taken together, and calibrated on fold 1. None where a class is missing."""
    f = features()
    rows = written(labelled.select("y", "fold", "times", F.struct(*[c.alias(k) for k, c in f.items()]).alias("x")).groupBy("y", "fold", "x").agg(F.sum("times").alias("weight")).select("y", "fold", "weight", "x.*"), "examples", folder)
    if {r["y"] for r in rows.filter("fold = 0").select("y").distinct().collect()} != {0, 1}:
        return None
    gather = VectorAssembler(inputCols=list(f), outputCol="x")
    trees = GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=20, maxDepth=4, stepSize=0.3, seed=7).fit(gather.transform(rows.filter("fold = 0")).select("y", "x", "weight"))
    held = scored(rows.filter("fold = 1"), trees, list(f)).groupBy("kind", F.floor(F.col("score") * 1000).alias("bin")).agg(F.sum(F.col("weight") * F.col("y")).alias("true"), F.sum("weight").alias("all"))
    above = Window.partitionBy("kind").orderBy(F.desc("bin"))  # 4 kinds of at most 1,001 bins
    least = held.select("kind", "bin", (F.sum("true").over(above) >= precision * F.sum("all").over(above)).alias("enough")).filter("enough").groupBy("kind").agg(F.min("bin").alias("bin"))
    return trees, {KINDS[int(r["kind"]) - 1]: max(500, r["bin"]) / 1000 for r in least.collect()}


def scored(rows: DataFrame, trees, names: list[str]) -> DataFrame:
    """rows with score double: the trees' probability that a proposal is true."""
    x = trees.transform(VectorAssembler(inputCols=names, outputCol="x").transform(rows))
    return x.withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def selected(spans: DataFrame, model: tuple | None) -> DataFrame:
    """(i, h, kind, start, end, score) of the proposals beside the base spans that their kind's threshold lets pass; of those that overlap the best one."""
    new = spans.filter(~F.col("base") & ~F.col("touches"))
    if not model or not model[1]:
        return new.select(*DOC, "kind", "start", "end", F.lit(0.0).alias("score")).filter("false")
    trees, thresholds = model
    f = features()
    s = scored(new.select(*DOC, "kind", "start", "end", *[c.alias(f"f_{k}") for k, c in f.items()]), trees, [f"f_{k}" for k in f]).select(*DOC, "kind", "start", "end", "score")
    passes = F.lit(False)
    for kind, t in thresholds.items():
        passes = passes | ((F.col("kind") == kind) & (F.col("score") >= t))
    w = Window.partitionBy(*DOC).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.filter(passes).withColumn("fresh", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    s = s.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(*DOC, "island").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    return s.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("fresh", "island", "r")


def found(docs: DataFrame, precision: float, text: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(one row (i, h) of every row of docs, the spans (i, h, kind, start, end, base, score) of every distinct id and text). Texts are read once."""
    folder = shared_folder(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = written(proposals(d, DOC, RULES), "proposals", folder)
    spans = written(with_overlaps(located(rows.filter("rule <> ''").distinct(), DOC), DOC), "spans", folder)
    model = fitted(examples(spans, folder), folder, precision)
    base = spans.filter("base").select(*DOC, "kind", "start", "end", F.lit(True).alias("base"), F.lit(1.0).alias("score"))
    new = selected(spans, model).select(*DOC, "kind", "start", "end", F.lit(False).alias("base"), "score")
    return rows.filter("rule = ''").select(*DOC), base.unionByName(new)


def listed(only: Column | None = None) -> Column:
    """kind:start:end of the grouped spans by start, then kind, comma-joined."""
    at = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "end", "kind")
    spans = F.sort_array(F.collect_list(at if only is None else F.when(only, at)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, precision: float = PRECISION, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of docs: base spans by the fixed rules, and those that the trees add.

    Base: the leftmost matches of each kind that don't overlap, those that fail its check left out. Generators of high recall propose what
    the rules miss (spelled or spaced addresses, other separators, numbers that a neighbouring number spoils); trees, boosted on
    disguised base spans and on decoys in their places, score them by format and context; a threshold of each kind, calibrated on examples that the
    trees have not seen for a share of `precision` true ones, selects; of overlapping ones the best stays, and none that shares a place with a base span.
    All base spans and all false proposals of the corpus are learned from, equal feature vectors as one row with a weight; a kind without base spans
    has no threshold and adds nothing. A text's pieces are held beside it while it is read; from there on each place is a row.

    A null text counts as empty; texts are read whole, once, in time that grows with their length. Rows are known by id and a hash of the text: null
    and shared ids are judged by their own text, repeated rows alike, each coming back once. Extra columns are not read, whatever their names; no
    documents give no rows.
    """
    rows, spans = found(docs, precision, text, id_col)
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    of = spans.groupBy(*DOC).agg(*counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed().alias("spans"), F.count(F.when(~F.col("base"), 1)).alias("n_added"))
    out = rows.join(of, DOC, "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.nullif("i", F.lit(NO_ID)).alias("doc_id"), *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))


def redact(docs: DataFrame, precision: float = PRECISION, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with each span of their texts replaced by its kind in brackets, spans that overlap by that of the first. Null texts stay null, rows and other columns as they are."""
    _, spans = found(docs, precision, text, id_col)
    w = Window.partitionBy(*DOC).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("fresh", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy(*DOC, "island").agg(F.min(F.struct("start", "end", "kind"))["kind"].alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"))
    s = s.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("h")).join(s, DOC, "left")
    body = F.col(f"row.`{text}`")
    before = lambda k: F.when(k > 0, F.col("s")[k - 1]["end"]).otherwise(0)
    parts = F.transform("s", lambda x, k: F.concat(F.substr(body, (before(k) + 1).cast("int"), (x["start"] - before(k)).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = F.substr(body, (F.element_at("s", -1)["end"] + 1).cast("int"))
    done = F.when(F.col("s").isNull(), body).otherwise(F.concat(F.array_join(parts, ""), tail))
    return d.select(*[done.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
