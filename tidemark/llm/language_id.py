"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, sample_share, slices

# First and last code point of the scripts told apart (letters elsewhere count as "Other").
SCRIPTS = [("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF)]

ORDERS = (2, 3, 4)
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
PIECE = 24
CAP = 12.0
CHUNK = 64
FAR = -1e4
# Fixed value: an odd factor for hashing code points.
FACTOR = np.uint32(0x9E3779B1)
#: Kinds of code points: white space, what is neither space nor letter, then a number for each script.
SPACE, NO_LETTER, FIRST_SCRIPT = 0, 1, 2
NAMES = ["Other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_points: list[np.ndarray] = []


def points() -> list[np.ndarray]:
    """For every code point its kind and its lower case (where that is one code point)."""
    if not _points:
        kind, lower = np.full(0x110000, NO_LETTER, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                kind[cp] = FIRST_SCRIPT
            elif ch.isspace():
                kind[cp] = SPACE
            if len(low := ch.lower()) == 1:
                lower[cp] = ord(low)
        letter = kind == FIRST_SCRIPT
        for name, a, b in SCRIPTS:
            kind[a : b + 1][letter[a : b + 1]] = FIRST_SCRIPT + NAMES.index(name)
        _points.extend([kind, lower])
    return _points


def composed(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case and kinds of all texts, each after a space, with four spaces at the end; and the places of those spaces."""
    kind, lower = points()
    cp = np.frombuffer((" " + " ".join(texts) + "    ").encode("utf-32-le", "surrogatepass"), "<u4")
    k = kind[cp]
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return np.where(k == SPACE, np.uint32(32), lower[cp]), k, first


def gram_slots(cp: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    """For each order the slot of the n-gram that begins at each place but the last four; SLOTS where it would hold a space other than at its ends.

    An n-gram lies inside a word with the space before and after it.
    """
    n, word = len(cp) - 4, kind != SPACE
    inner = [word[:n] | word[1 : n + 1], word[1 : n + 1], word[1 : n + 1] & word[2 : n + 2]]
    h, out = cp[:n] * FACTOR, []
    for k in range(1, max(ORDERS)):
        h = (h ^ (h >> np.uint32(15)) ^ cp[k : n + k]) * FACTOR
        out.append(np.where(inner[k - 1], h >> np.uint32(32 - SLOT_BITS), np.uint32(SLOTS)))
    return out


def units(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of a text begin (with the space before a word) and whether that is a space.

    A unit is a word, cut before each letter of another script than the letter before it, and after every PIECE characters.
    An n-gram belongs to the unit in which it begins, so none is lost at a cut.
    """
    n = len(kind) - 4
    word = kind[:n] != SPACE
    begin = np.flatnonzero(word[1:] & ~word[:-1])
    cuts = [begin]
    ends = np.flatnonzero(word & (kind[1 : n + 1] == SPACE)) + 1
    size = ends - begin - 1
    long = size > PIECE
    if long.any():
        parts = (size[long] - 1) // PIECE
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        cuts.append(np.repeat(begin[long] + 1, parts) + k * PIECE)
    letters = np.flatnonzero(kind[:n] >= FIRST_SCRIPT)
    scripts = kind[letters]
    if len(letters) and (scripts != scripts[0]).any():
        of = np.cumsum(word[1:] & ~word[:-1])  # the word of each place but the first
        changed = (scripts[1:] != scripts[:-1]) & (of[letters[1:] - 1] == of[letters[:-1] - 1])
        cuts.append(letters[1:][changed])
    if len(cuts) == 1:
        return begin, np.ones(len(begin), bool)
    starts = np.sort(np.concatenate(cuts), kind="stable")
    starts = starts[np.concatenate([[True], starts[1:] != starts[:-1]])]
    return starts, ~word[starts]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = 600, min_share: float = 0.01) -> dict:
    """The model: log probabilities of hashed character 2- to 4-grams per language, and the scripts each language uses.

    Learns from rows of folds 0 and 2 with text and language. Counts of rows per language cover all of them; the n-grams come
    from a bounded sample of about per_language whole texts of each, taken by a hash of the id. A script counts for a
    language from min_share of its letters. No learnable rows give a model without languages.
    """
    fit = docs.filter((fold(id_col) != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r["l"]: r["n"] for r in fit.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "table": np.zeros((1, 0), np.float32), "allowed": np.zeros((FIRST_SCRIPT + len(NAMES), 0), bool), "prior": []}
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))]), F.col("l"))
    place = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(langs), SLOTS + 1), np.int64)
        scripts = np.zeros((len(langs), FIRST_SCRIPT + len(NAMES)), np.int64)
        for b in batches:
            for t, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for part in slices(composed(t.as_py())):
                    cp, kind, _ = read([part])
                    for s in gram_slots(cp, kind):
                        n[place[k]] += np.bincount(s, minlength=SLOTS + 1)
                    scripts[place[k]] += np.bincount(kind, minlength=scripts.shape[1])
        for slot, c in ((True, n[:, :SLOTS]), (False, scripts)):
            at = np.argwhere(c)
            yield pa.RecordBatch.from_pydict({"k": pa.array(at[:, 0], pa.int32()), "gram": pa.array([slot] * len(at), pa.bool_()), "at": pa.array(at[:, 1], pa.int32()), "n": pa.array(c[at[:, 0], at[:, 1]], pa.int64())})

    # at most a row for each language and slot reaches the driver
    got = fit.filter(sample_share("i", share)).select("t", "l").mapInArrow(count, "k int, gram boolean, at int, n long").groupBy("k", "gram", "at").agg(F.sum("n").alias("n")).toPandas()
    n, scripts = np.zeros((len(langs), SLOTS)), np.zeros((len(langs), FIRST_SCRIPT + len(NAMES)))
    for c, rows in ((n, got[got.gram.astype(bool)]), (scripts, got[~got.gram.astype(bool)])):
        c[rows.k.to_numpy(int), rows["at"].to_numpy(int)] = rows.n.to_numpy(float)
    table = np.zeros((SLOTS + 1, len(langs)), np.float32)
    table[:SLOTS] = (np.log((n + 0.1) / (n.sum(axis=1, keepdims=True) + 0.1 * SLOTS)) / len(ORDERS)).T
    scripts[:, :FIRST_SCRIPT] = 0
    allowed = ((scripts > 0) & (scripts >= min_share * scripts.sum(axis=1, keepdims=True))).T
    return {"langs": langs, "table": table, "allowed": allowed, "prior": [sizes[x] for x in langs]}


def unit_scores(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores, letters, text, from) of all units of the texts, in order.

    Scores are relative to the best language that the unit's script allows and at least -CAP; languages that it rules out have -2 * CAP;
    units without letters, or in a script of no learned language, score 0 for all.
    """
    cp, kind, first = read(texts)
    starts, spaced = units(kind)
    if not len(starts):
        return np.zeros((0, len(model["langs"]))), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    table, total = model["table"], None
    for s in gram_slots(cp, kind):
        x = np.take(table, s, axis=0)
        total = x if total is None else np.add(total, x, out=total)
    n = len(cp) - 4
    s = np.ascontiguousarray(np.add.reduceat(total, starts, axis=0).T).astype(np.float64)
    letters = np.add.reduceat((kind[:n] >= FIRST_SCRIPT).astype(np.int32), starts)
    script = np.maximum.reduceat(kind[:n], starts)
    ok = np.ascontiguousarray(model["allowed"].T)[:, script]
    known = ok.any(axis=0)
    s[~ok] = -np.inf
    s -= np.where(known, s.max(axis=0), 0.0)
    s = np.where(ok, np.maximum(s, -CAP), np.where(known, -2 * CAP, 0.0)).T
    at = starts + spaced
    text = np.searchsorted(first, at, "right") - 1
    return s, letters, text, at - first[text] - 1


def constant(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(label, settled) of each text: the language of the best sum, and whether no other path can score more than it throughout.

    Let m be what a unit gains at most by another language than that. A path that leaves it between two of its units pays two
    switches, at an end of the text one, and anywhere at all at least one: it gains nothing while no stretch of m sums to more than
    two penalties and no stretch from an end to more than one. Else the Viterbi path decides.
    """
    first = np.cumsum(lengths) - lengths
    sums = np.add.reduceat(scores, first, axis=0)
    label = sums.argmax(axis=1)
    own = np.repeat(label, lengths)
    at = np.arange(len(scores))
    other = np.array(scores.T)
    mine = other[own, at]
    other[own, at] = -np.inf
    m = other.max(axis=0) - mine if scores.shape[1] > 1 else np.full(len(scores), -1.0)
    upto = np.cumsum(m)
    base = np.repeat(upto[first] - m[first], lengths)
    upto -= base  # sums from each text's own beginning
    text = np.repeat(np.arange(len(lengths)), lengths)
    whole, most = np.add.reduceat(m, first), np.maximum.reduceat(upto, first)
    step = float((np.maximum(most, 0) - np.minimum(np.minimum.reduceat(upto - m, first), 0)).max()) + 1.0  # keeps the texts' sums apart
    low = np.minimum.accumulate(np.minimum(upto - m, 0.0) - step * text) + step * text  # the least sum before, of this text alone
    low = np.minimum(low, 0.0)
    tail = whole - np.minimum(np.minimum.reduceat(upto - m, first), 0.0)
    inner = np.maximum.reduceat(upto - low, first)
    slack = 1e-9 * step * len(lengths)
    return label, (most <= penalty - slack) & (tail <= penalty - slack) & (inner <= 2 * penalty - slack)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each unit: scores (units, labels) of texts laid end to end, lengths of the texts; each switch inside a text costs penalty.

    Texts are cut into chunks of CHUNK units. A first sweep finds every chunk's best score from each entry label to each
    exit label, all chunks at once; a scan along each text then fixes the entries and exits, and a second sweep the path.
    """
    words, k = scores.shape
    chunks = np.maximum(1, -(-lengths // CHUNK))
    first = np.cumsum(chunks) - chunks
    start = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), chunks)
    begin = start[text] + (np.arange(chunks.sum()) - first[text]) * CHUNK
    size = np.minimum(begin + CHUNK, (start + lengths)[text]) - begin
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    live = [int(np.searchsorted(-size_o, -t, side="left")) for t in range(int(size.max(initial=0)))]  # chunks longer than t come first
    reach = np.full((len(size), k, k), FAR * CHUNK)
    reach[:, np.arange(k), np.arange(k)] = 0.0
    for t, n in enumerate(live):
        v = reach[:n]
        reach[:n] = np.maximum(v, v.max(axis=2, keepdims=True) - penalty) + scores[begin_o[:n] + t][:, None, :]
    where = np.empty(len(order), int)
    where[order] = np.arange(len(order))
    enter, leave = np.zeros(len(size), int), np.zeros(len(size), int)
    single = chunks[text] == 1
    s = reach[where[single]].max(axis=1) if k else np.zeros((single.sum(), 0))
    leave[single] = s.argmax(axis=1)
    enter[single] = reach[where[single]][np.arange(single.sum()), :, leave[single]].argmax(axis=1)
    for d in np.flatnonzero(chunks > 1):
        v, back = np.zeros(k), []
        for c in range(first[d], first[d] + chunks[d]):
            total = v[:, None] + reach[where[c]]
            back.append(total.argmax(axis=0))
            v = total.max(axis=0)
        out = int(v.argmax())
        for c in range(first[d] + chunks[d] - 1, first[d] - 1, -1):
            leave[c], enter[c] = out, back[c - first[d]][out]
            out = enter[c]
    enter_o, leave_o = enter[order], leave[order]
    v = np.full((len(size), k), FAR * CHUNK)
    v[np.arange(len(size)), enter_o] = 0.0
    back = np.zeros((len(live), len(size)), np.int8 if k < 128 else np.int32)
    stay = np.zeros((len(live), len(size), k), bool)
    for t, n in enumerate(live):
        best = v[:n].argmax(axis=1)
        switch = v[:n].max(axis=1, keepdims=True) - penalty
        stay[t, :n] = v[:n] >= switch
        back[t, :n] = best
        v[:n] = np.maximum(v[:n], switch) + scores[begin_o[:n] + t]
    path, at = np.zeros(words, np.int32), leave_o.copy()
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        path[begin_o[:n] + t] = at[:n]
        at[:n] = np.where(stay[t, np.arange(n), at[:n]], at[:n], back[t, :n])
    return path


def best_path(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The label of every unit: one throughout where constant() proves it best, else the Viterbi path."""
    label, settled = constant(scores, lengths, penalty)
    path = np.repeat(label, lengths).astype(np.int32)
    if not settled.all():
        open_units = np.repeat(~settled, lengths)
        path[open_units] = viterbi(scores[open_units], lengths[~settled], penalty)
    return path


def label_texts(texts: list[str | None], model: dict, penalty: float, spans: bool, size: int) -> tuple[list, list, list]:
    """lang_pred, score and spans of each text; `size` characters are scored at a time, so a longer text is scored in parts and labelled as one."""
    langs = model["langs"]
    names, shares, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    parts = [(i, p) for i, t in enumerate(texts) if t and langs for p in slices(composed(t), size)]
    shift = np.zeros(len(parts), np.int64)
    for k in range(1, len(parts)):
        if parts[k][0] == parts[k - 1][0]:
            shift[k] = shift[k - 1] + len(parts[k - 1][1])
    got, at = [], 0
    while at < len(parts):
        end, chars = at, 0
        while end < len(parts) and (end == at or chars + len(parts[end][1]) <= size):
            chars += len(parts[end][1])
            end += 1
        s, letters, text, place = unit_scores([p for _, p in parts[at:end]], model)
        got.append((s, letters, np.array([i for i, _ in parts[at:end]])[text], place + shift[at:end][text]))
        at = end
    if not sum(len(g[0]) for g in got):
        return names, shares, found
    scores, letters, of, place = (np.concatenate(c) for c in zip(*got, strict=True))
    rows, lengths = np.unique(of, return_counts=True)
    path = best_path(scores, lengths, penalty)
    row = np.repeat(np.arange(len(rows)), lengths)
    n = np.bincount(row * len(langs) + path, weights=letters, minlength=len(rows) * len(langs)).reshape(len(rows), len(langs))
    known = np.bincount(row, weights=np.abs(scores).sum(axis=1)) > 0
    prior = int(np.argmax(model["prior"]))
    ends = np.cumsum(lengths)
    for r, i in enumerate(rows):
        if n[r].sum():
            best = int(n[r].argmax()) if known[r] else prior
            names[i], shares[i] = langs[best], float(n[r].max() / n[r].sum()) * (1.0 if known[r] else 0.5)
            if spans:
                p, q = path[ends[r] - lengths[r] : ends[r]], place[ends[r] - lengths[r] : ends[r]]
                cut = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist()]
                stop = [*(int(q[c]) for c in cut[1:]), len(composed(texts[i]))]
                found[i] = [{"char_from": int(q[a]), "char_to": b, "lang": langs[p[a]]} for a, b in zip(cut, stop, strict=True)]
    return names, shares, found


def identify(docs: DataFrame, model: dict, text: str = "text", penalty: float = 8.0, spans: bool = False, batch_chars: int = 1 << 19) -> DataFrame:
    """docs with lang_pred string, score double and, if asked for, lang_spans array<struct<char_from, char_to, lang>>.

    Units are words, cut where the script changes and after PIECE characters, so that text without spaces has as many as
    its length asks for. lang_pred is the learned language with most letters in the labelled units (of equals the first
    by name), `und` where the text is null or has no letter or nothing was learned; score is its share of the letters,
    halved where no language learned uses the text's scripts (then the most frequent language is named), and 0 for `und`.
    Every character counts at any length. Spans begin at a unit and reach to the next one's; their offsets are those
    of the text in composed form (NFC), which is the text itself nearly always. Columns of docs called lang_pred, score or lang_spans
    are replaced; each row, repeated or not, comes back once; no rows give none. Memory: batch_chars of text at a time
    are scored; a longer text is held whole beside the scores of its units.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans")]
    src = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", lang_pred string, score double" + ", lang_spans array<struct<char_from: int, char_to: int, lang: string>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(whole.schema.get_field_index(text))
            at = 0
            while at < whole.num_rows:
                end, chars, part = at, 0, []
                while end < whole.num_rows and (not part or chars < batch_chars):
                    part.append(t := texts[end].as_py())
                    chars += len(t or "")
                    end += 1
                names, scores, found = label_texts(part, model, penalty, spans, batch_chars)
                more = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                if spans:
                    more.append(pa.array(found, pa.list_(pa.struct([("char_from", pa.int32()), ("char_to", pa.int32()), ("lang", pa.string())]))))
                b = whole.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*keep, "lang_pred", "score", "lang_spans"][: len(keep) + len(more)])
                at = end

    return src.mapInArrow(run, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: learns from folds 0 and 2, predicts from text alone."""
    model = learn(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
