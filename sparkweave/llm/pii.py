"""Personal data (operator 9): fixed rules, and a linear-chain conditional random field over word shapes.

The rules find emails, addresses, cards and phones in whole texts.  The field labels all words of each text (long texts in
overlapping stretches), and adds what the rules miss: numbers written without the usual signs, spelled-out email addresses, secrets.
It is trained on the driver from a small labelled table (``training_table``, or one given), and decoded by Viterbi over padded numpy batches.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
CONTEXT = 2
#: words of a stretch of a long text, and how many of them at either end only give context
STRETCH, OVERLAP = 256, 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # number of the kind, start, end in code points


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one at sign, so the signs are walked from left to right; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind, then start."""
    out: list[Span] = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


# --- the labelled table


def training_table(sentences: int = 300, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Labelled sentences (words, tags) made from a few patterns, and half as many without digits: tags are O, B-kind and I-kind."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwxyzéäöñ") for _ in range(r.randint(2, 11)))
    plain = lambda: r.choice([word(), word().capitalize(), word() + ",", word() + ".", word().upper()])

    def card() -> str:
        d = digits(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def entity() -> tuple[str, list[str]]:
        kind = r.choice(KINDS)
        if kind == "email":
            host = f"{word()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com', 'net'])}"
            name = f"{word()}.{digits(2)}"
            return kind, r.choice([[f"{name}@{host}"], [name, "[at]", host], [name, "(at)", host], [name + "@", host]])
        if kind == "ip":
            parts = [str(r.randint(1, 255)) for _ in range(4)]
            return kind, [r.choice([".".join(parts), ".".join(parts) + f":{r.randint(80, 65000)}"])]
        if kind == "card":
            c = card()
            return kind, r.choice([[c], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join((c[:4], c[4:8], c[8:12], c[12:]))]])
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, r.choice([["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{digits(2)}", a, b, c], [f"+{digits(11)}"]])
        key = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64])))
        return kind, [r.choice([f'"{key}"', key, f"'{key}'"])]

    def phrase() -> tuple[list[str], list[str]]:
        """Personal data without a digit, or words that look like it."""
        if r.random() < 0.4:
            name = r.choice([f"{word()}.{word()}", word(), f"{word()}_{word()}"])
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)")])
            last = r.choice(["com", "org", "net"])
            parts = r.choice([[name, at, f"{word()}.{last}"], [name, at, word(), dot, last]])
            return parts, ["B-email"] + ["I-email"] * (len(parts) - 1)
        key = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(8, 24)))
        name, other_name = r.choice(["token", "key", "secret", "password"]), r.choice([word(), "version", word().capitalize()])
        return r.choice([([name, "=", r.choice([key, f'"{key}"'])], ["O", "O", "B-secret"]), ([name + r.choice(":="), key], ["O", "B-secret"]), ([other_name, "=", key], ["O"] * 3), ([name, word(), key], ["O"] * 3), ([f"{word()}.{word()}"], ["O"]), ([f"({word()}", f"{word()})"], ["O"] * 2), ([f"({word()})"], ["O"]), ([f"[{word()}]"], ["O"]), ([f"{word()}_{word()}"], ["O"]), ([f"www.{word()}.org"], ["O"]), ([r.choice(["=", "-", "|", "#", "&"])], ["O"]), ([key], ["O"])])

    def other() -> list[str]:
        return r.choice([["version", f"{r.randint(1, 9)}.{r.randint(0, 9)}."], [f"{r.randint(1900, 2030)}"], [f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}"], [digits(r.randint(1, 5))], [f"{r.randint(1, 99)}%"], [f"${digits(3)}.{digits(2)}"], ["Version", "2.0,"], ["CC", "BY-NC", "4.0."], [f"{digits(2)}:{digits(2)}"], [word() + digits(1)], ["@"], [f"{digits(1)},{digits(3)}"], [digits(r.randint(6, 12))], [f"@{word()}"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(1)}{r.choice(['st', 'nd', 'th'])}"], [f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}"]])

    out = []
    for _ in range(sentences):
        words, tags = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 3)):
                words.append(plain())
                tags.append("O")
            if r.random() < 0.5:
                kind, parts = entity()
                if kind == "secret" and r.random() < 0.6:
                    words += [r.choice(["token", "key", "secret", "password"]), "="]
                    tags += ["O", "O"]
                parts = list(parts)
                parts[-1] += r.choice(["", "", "", ".", ",", "###", "%%%", "!!"])
                words += parts
                tags += [f"B-{kind}"] + [f"I-{kind}"] * (len(parts) - 1)
            else:
                extra = other()
                words += extra
                tags += ["O"] * len(extra)
        for _ in range(r.randint(0, 2)):
            words.append(plain())
            tags.append("O")
        out.append((words, tags))
    for _ in range(sentences // 2):
        words, tags = [], []
        for _ in range(r.randint(1, 3)):
            some = [plain() for _ in range(r.randint(0, 3))]
            extra, marks = phrase()
            words += some + extra
            tags += ["O"] * len(some) + marks
        some = [plain() for _ in range(r.randint(0, 2))]
        out.append((words + some, tags + ["O"] * len(some)))
    return out


# --- the field

TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
_CUES = frozenset(("token", "key", "secret", "password", "version", "=", "[at]", "(at)", "[dot]", "(dot)", *(f"{n}{c}" for n in ("token", "key", "secret", "password") for c in ":=")))
_EDGE = ".,;:!?\"'*#%&$|<>"


def _shape(word: str) -> str:
    """Character classes in order, runs merged; long shapes are cut after 16 classes."""
    out = []
    for c in word[:80]:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:16])


def _word_features(word: str) -> list[str]:
    core = word.strip(_EDGE)
    shape, n = _shape(core), sum(map(str.isdigit, core))
    runs = [len(x) for x in re.findall(r"[0-9]+", core)]
    f = [f"s={shape}", f"n={min(n, 20)}", f"l={min(len(core), 42) // 2}", f"r={'.'.join(str(min(x, 20)) for x in runs[:5])}", f"o={'@' in core}{core[:1] == '+'}{core[:1] == '('}"]
    if len(core) >= 20 and n and all(c in "0123456789abcdefABCDEF" for c in core):
        f.append("hex")
    if runs and len(runs) == 1 and 13 <= n <= 19 and core.isdigit():
        f.append(f"luhn={luhn(core) if core.isascii() else False}")
    if (w := word.lower()) in _CUES:
        f.append(f"w={w}")
    return f


def _kind(word: str) -> tuple:
    """Equal for words of equal features; quick for letters only."""
    core = word.strip(_EDGE)
    if core.isalpha() and word.lower() not in _CUES:
        shape = "x" if core.islower() else "Xx" if core[0].isupper() and core[1:].islower() else None
        if shape:
            return shape, min(len(core), 42) // 2
    return tuple(_word_features(word))


def features(words: list[str]) -> list[list[str]]:
    """Feature names of each word of a sequence: its own, and its neighbours' shapes and cues."""
    own = [_word_features(w) for w in words]
    out = []
    for i, f in enumerate(own):
        more = ["bias"]
        for step in _STEPS:
            if 0 <= i + step < len(words):
                o = own[i + step]
                more += [f"{step}{o[0]}", f"{step}{o[3]}"] + [f"{step}{x}" for x in o if x[:2] == "w="]
            else:
                more.append(f"{step}edge")
        out.append(f + more)
    return out


_STEPS = (-2, -1, 1, 2)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Linear-chain conditional random field: feature weights, transition and start scores."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.names, self.emit, self.move, self.start = names, emit, move, start

    @classmethod
    def fit(cls, table: list[tuple[list[str], list[str]]], steps: int = 100, rate: float = 0.3, ridge: float = 1e-3) -> Field:
        """Maximum likelihood by AdaGrad over the whole table; deterministic."""
        tag = {t: i for i, t in enumerate(TAGS)}
        known = [features(w) for w, _ in table]
        names = {f: i for i, f in enumerate(sorted({f for s in known for w in s for f in w}))}
        s, longest, b = len(TAGS), max(len(w) for w, _ in table), len(table)
        mask, gold = np.zeros((b, longest), bool), np.zeros((b, longest), np.int64)
        rows, cols = [], []
        for k, (_, tags) in enumerate(table):
            for t, name in enumerate(tags):
                mask[k, t], gold[k, t] = True, tag[name]
                ids = [names[f] for f in known[k][t]]
                rows += [k * longest + t] * len(ids)
                cols += ids
        rows, cols = np.array(rows), np.array(cols)
        emit, move, start = np.zeros((len(names), s)), np.zeros((s, s)), np.zeros(s)
        squares = [np.full_like(x, 1e-8) for x in (emit, move, start)]
        one = np.eye(s)[gold] * mask[..., None]
        for _ in range(steps):
            score = np.zeros((b * longest, s))
            np.add.at(score, rows, emit[cols])
            score = score.reshape(b, longest, s)
            a = np.zeros_like(score)
            a[:, 0] = start + score[:, 0]
            for t in range(1, longest):
                step = _log_sum(a[:, t - 1, :, None] + move, 1) + score[:, t]
                a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
            z = _log_sum(a[:, -1], 1)
            back = np.zeros_like(score)
            d_move = np.zeros_like(move)
            for t in range(longest - 2, -1, -1):
                ahead = move + (score[:, t + 1] + back[:, t + 1])[:, None, :]
                back[:, t] = np.where(mask[:, t + 1, None], _log_sum(ahead, 2), 0)
                pair = np.exp(np.minimum(a[:, t, :, None] + ahead - z[:, None, None], 0)) * mask[:, t + 1, None, None]
                d_move -= pair.sum(axis=0)
            state = np.exp(np.minimum(a + back - z[:, None, None], 0)) * mask[..., None]
            diff = one - state
            d_emit = np.zeros_like(emit)
            np.add.at(d_emit, cols, diff.reshape(-1, s)[rows])
            for t in range(longest - 1):
                np.add.at(d_move, (gold[:, t][mask[:, t + 1]], gold[:, t + 1][mask[:, t + 1]]), 1)
            for w, g, q in zip((emit, move, start), (d_emit, d_move, diff[:, 0].sum(axis=0)), squares, strict=True):
                g = g - ridge * b * w
                q += g * g
                w += rate * g / np.sqrt(q)
        return cls(names, emit, move, start)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Place of each word in ``self.known``: the scores that it gives to itself and to the words around it."""
        memo = self.__dict__.setdefault("memo", {})
        if len(memo) > 200_000:
            memo.clear()
        fresh = {w for w in words if w not in memo}
        if not memo:
            memo[None], self.rows = 0, {}
            self.known = np.array([[np.zeros(len(TAGS))] + [self._sum([f"{k}edge"]) for k in _STEPS]])
        new = []
        for w in fresh:
            kind = _kind(w)
            if kind not in self.rows:
                own, around = self._parts(w)
                self.rows[kind] = len(self.rows) + 1
                new.append([self._sum(own)] + [self._sum(g) for g in around])
            memo[w] = self.rows[kind]
        if new:
            self.known = np.concatenate([self.known, np.array(new)])
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _parts(word: str) -> tuple[list[str], list[list[str]]]:
        own = _word_features(word)
        return ["bias", *own], [[f"{k}{own[0]}", f"{k}{own[3]}"] + [f"{k}{x}" for x in own if x[:2] == "w="] for k in _STEPS]

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.emit[[self.names[f] for f in names if f in self.names]].sum(axis=0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "rows", "known")}

    def decode(self, sequences: list[list[str]], batch: int = 512) -> list[list[int]]:
        """Best tags of each sequence by Viterbi, ``batch`` padded stretches of like length at a time.

        A sequence of more than STRETCH words is decoded in stretches, of which OVERLAP words at each inner end are left to the neighbour.
        """
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        ids = self._rows([w for s in sequences for w in s])
        tags, ends = np.zeros(len(ids), np.int8), np.cumsum(sizes)
        step = STRETCH - 2 * OVERLAP
        parts = [(lo, min(lo + STRETCH, e), s, e) for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True) for lo in range(s, max(s + 1, e - 2 * OVERLAP), step) if lo < e]
        parts.sort(key=lambda p: p[1] - p[0])
        for at in range(0, len(parts), batch):
            some = parts[at : at + batch]
            lo, hi, first, last = np.array(some).T
            best = self._viterbi(ids, lo, hi, first, last)
            place = np.arange(best.shape[1])
            from_, to = np.where(lo > first, OVERLAP, 0), np.where(hi < last, hi - lo - OVERLAP, hi - lo)
            keep = (place >= from_[:, None]) & (place < to[:, None])
            tags[(lo[:, None] + place)[keep]] = best[keep]
        flat = tags.tolist()
        return [flat[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]

    def _viterbi(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        size, s = hi - lo, len(TAGS)
        place = lo[:, None] + np.arange(size.max())
        word = lambda at: np.where((at >= first[:, None]) & (at < last[:, None]), ids[np.clip(at, 0, len(ids) - 1)], 0)
        score = self.known[word(place), 0]
        for k, step in enumerate(_STEPS):
            score += self.known[word(place + step), k + 1]
        best, came, move = self.start + score[:, 0], np.zeros((len(lo), size.max(), s), np.int8), np.ascontiguousarray(self.move.T)
        for t in range(1, size.max()):
            paths = best[:, None, :] + move
            back = paths.argmax(axis=2)
            live = (t < size)[:, None]
            came[:, t] = np.where(live, back, np.arange(s))
            best = np.where(live, np.take_along_axis(paths, back[..., None], 2)[..., 0] + score[:, t], best)
        out, rows = np.zeros(came.shape[:2], np.int8), np.arange(len(lo))
        tag = best.argmax(axis=1)
        for t in range(size.max() - 1, -1, -1):
            out[:, t] = tag
            tag = came[rows, t, tag]
        return out


def neighbourhoods(text: str) -> list[list[tuple[int, int]]]:
    """Word spans around the words with a digit or at sign; one list for each sequence."""
    marks = [m.span() for m in _MARK.finditer(text)] if "@" in text or _DIGIT.search(text) else []
    out: list[list[tuple[int, int]]] = []
    for a, b in marks:
        if out and a < out[-1][-1][1]:
            if (a, b) in out[-1][-CONTEXT:]:
                known = out[-1].index((a, b), len(out[-1]) - CONTEXT)
                del out[-1][known + 1 :]
                out[-1] += _after(text, b)
                continue
        before = _before(text, a)
        if out and before and before[0][0] <= out[-1][-1][1]:
            out[-1] += [w for w in before if w[0] >= out[-1][-1][1]]
        else:
            out.append(before)
        out[-1] += [(a, b), *_after(text, b)]
    return out


def _after(text: str, at: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    while len(out) < CONTEXT and (m := _WORD.search(text, at)):
        out.append(m.span())
        at = m.end()
    return out


def _before(text: str, at: int) -> list[tuple[int, int]]:
    """The last words before a place; looks back over growing stretches, each begun at a blank."""
    reach = 64
    while True:
        lo = max(0, at - reach)
        words = [m.span() for m in _WORD.finditer(text, lo, at)]
        if lo and words and words[0][0] == lo:
            words = words[1:]  # it may begin before the stretch
        if lo == 0 or len(words) >= CONTEXT:
            return words[-CONTEXT:]
        reach *= 8


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """The field's spans in each text that do not overlap a rule's."""
    out: list[list[Span]] = [[] for _ in texts]
    for k, (text, tags) in enumerate(zip(texts, field.decode([_WORD.findall(t) for t in texts]), strict=True)):
        if not any(tags):
            continue
        spans = [m.span() for m in _WORD.finditer(text)]
        found: list[list[int]] = []
        for (a, b), t in zip(spans, tags, strict=True):
            kind = (t - 1) // 2
            if not t:
                found.append([-1, 0, 0])
            elif t % 2 or not found or found[-1][0] != kind:
                found.append([kind, a, b])
            else:
                found[-1][2] = b
        for kind, a, b in found:
            if kind < 0:
                continue
            while b > a and text_edge(texts[k][b - 1]):
                b -= 1
            while a < b and text_edge(texts[k][a]):
                a += 1
            if a < b and not any(x < b and a < y for _, x, y in base[k]):
                out[k].append((kind, a, b))
    return out


def text_edge(c: str) -> bool:
    return c in _EDGE


def find(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """The input's columns (``base`` and ``spans`` replaced, ``text`` never null), base and spans for every row of (doc_id, text): arrays of (kind, start, end), code points, end exclusive.

    ``base`` are the rules' spans and ``spans`` all, both by kind as in ``KINDS``, then start.  ``table`` replaces the labelled table.
    A null text is empty and has none; rows are judged each for itself; ties between tag sequences go to the tag listed first.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    field = Field.fit(table or training_table())
    held = docs.sparkSession.sparkContext.broadcast(field)
    named = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)]

    plain = docs.drop("base", "spans").withColumn("text", F.coalesce("text", F.lit("")))
    names = plain.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(names.index("text")).to_pylist()
                base = [base_spans(t) for t in texts]
                both = [b + a for b, a in zip(base, added_spans(texts, base, held.value), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(named, base)), spans), pa.array(list(map(named, both)), spans)], names=[*names, "base", "spans"])

    found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return plain.mapInArrow(each, T.StructType([*plain.schema.fields, T.StructField("base", found), T.StructField("spans", found)]))


def listed(spans: str) -> F.Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def redact(text: str, spans: str) -> F.Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stays, the rest are merged into it."""
    ordered = f"array_sort({spans}, (x, y) -> CASE WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 WHEN x.end > y.end THEN -1 WHEN x.end < y.end THEN 1 ELSE 0 END)"
    start = "named_struct('out', '', 'at', cast(0 as bigint))"
    step = f"if(s.start < a.at, named_struct('out', a.out, 'at', greatest(a.at, s.end)), named_struct('out', concat(a.out, substring({text}, cast(a.at + 1 as int), cast(s.start - a.at as int)), '<', upper(s.kind), '>'), 'at', s.end))"
    return F.expr(f"aggregate({ordered}, {start}, (a, s) -> {step}, a -> concat(a.out, substring({text}, cast(a.at + 1 as int))))")
