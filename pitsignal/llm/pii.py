"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers; what they find
always stays. The field adds spans that patterns miss, such as national phone numbers. It labels the words of a
line with B-kind, I-kind or O from the shapes of the word and its neighbours. It is trained on the table ``LABELLED`` by
gradient ascent on the exact likelihood, and decoded by Viterbi over batches of lines in numpy. Words without
digits or ``@`` never begin a span, so only lines that hold such a word are decoded.

Nulls and edge cases: a null or empty text has no spans. Rows are judged one by one, so repeated rows, ties and null ids
need no care. Every pattern takes time in proportion to the text, however long a run of digits or letters is. Offsets count code
points, the end is exclusive. Lines of any length are decoded whole, in time that grows with their words. Columns other than id and text are not looked at, and ``redact`` leaves them as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import id_and_text

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]

# Labelled lines, a span written as [kind|text], all invented. Digits stand for their shape only.
LABELLED = """
call me at [phone|(555) 123-4567] after noon
my number is [phone|555-123-4567].
tel: [phone|0521 555 0143] or write
phone [phone|030/1234567] in Berlin
Telefon [phone|089 1234 5678], abends
fax [phone|(089) 123456] bitte
ring [phone|555.123.4567] today
tel. [phone|01 23 45 67 89] le soir
appelez le [phone|01.23.45.67.89] vite
móvil [phone|612 345 678] por favor
llame al [phone|91-555-0188] hoy
reach us: [phone|+1 (030) 555-0172] for that
the of [phone|+49 30 1234567] and with
call [phone|1-800-555-0199] now
[phone|(212) 555-0187]
write to [email|jo.07@mail1.example.com] of the
mail [email|a.b@example.org], please
contact [email|info@example.com].
the [email|er.93@mail0.example.com] and of
[email|x_y@host.example.net]
server [ip|203.0.113.80] is down
from [ip|10.0.0.1] to [ip|192.168.12.4].
the of [ip|198.51.100.54] | and
host [ip|10.1.2.3:8080] answers
card [card|4111 1111 1111 1111] was charged
pay with [card|4111-1111-1111-1111], thanks
the of [card|4111111111111111] with and
Karte [card|5500 0000 0000 0004] gesperrt
on 2024-05-12 at 10:30 we met
version 3.0 of the License, Version 2.0.
the GNU General Public License, version 3.
token = "5a1f0c9e7b3d2846a0c4e8f1b5d7930261eca84f" of the
token = "0b9d4f7e21a86c35d0e7f4a9b8c2163507fedc9a" and
it costs 1,234.50 or 99 % more
in 1999 and 2004 there were 12 of them
chapter 12, page 345, line 6
release 1.2.3 and 1.2.3.4-rc1 came late
order 123456 was sent 12/05/2024
room 12-34 in block 5
the ratio 3:4 and 16:9 are common
account 1234567890123456 is no card here
the of 1234098756781235 with and
of 0009123400567813 on the
id 12345678901234567890 was used
between 100-200 and 300-400 of the
call @home or @work soon
see fig. 12.5 and table 3-4
Is and the for there of with that
The and attion to thanedble the, anea.
der die und nicht mit von der
THE AND OF!! WITH!! FOR!!
iner*** ther$$$ of### the&&& and%%%
thing | of | and | the | for.
los de la y que en el
les de la et que dans le
score 12 34 56 was noted
from 10 to 20 or 30 of 40
"""

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the local part before it and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        # No local part reaches over an @ or into a match.
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]


def _small(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or "0") <= 255


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = zip(KINDS, (emails(text), ips(text), cards(text), phones(text)), strict=True)
    return [(kind, a, b) for kind, spans in found for a, b in spans]


# -- the field ---------------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Runs of digits with their length up to 5, runs of letters by case, other marks once each in a row."""
    out: list[str] = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|(.)\1*", word):
        part = m.group()
        if part[0] in "0123456789":
            out.append(f"d{min(len(part), 5) if len(part) < 13 else 6}")
        elif m.group(1) is None:
            out.append("A" if part.isupper() and len(part) > 1 else "a")
        else:
            out.append(part[0])
    return "".join(out)


def traits(words: list[str]) -> list[list[str]]:
    """The features of each word of a line."""
    bare = [w.strip(".,;:!?\"'|") for w in words]
    forms = ["<", *[shape(w) for w in bare], ">"]
    out = []
    for i, w in enumerate(bare):
        digits = sum(c in "0123456789" for c in w)
        mine = [f"0{forms[i + 1]}", f"-{forms[i]}", f"+{forms[i + 2]}", f"n{min(digits, 20)}",
                f"p{forms[i]}/{forms[i + 1]}", f"q{forms[i + 1]}/{forms[i + 2]}", "one"]
        if not digits and "@" not in w:
            mine.append("plain")
        if 13 <= digits <= 19:
            mine.append(f"luhn{luhn(''.join(c for c in w if c in '0123456789'))}")
        out.append(mine)
    return out


def labelled_rows() -> list[tuple[list[str], list[int]]]:
    """Words and tag numbers of the labelled table."""
    out = []
    for line in LABELLED.strip().split("\n"):
        words, tags = [], []
        for part in re.split(r"(\[\w+\|[^]]*\]\S*)", line):
            m = re.fullmatch(r"\[(\w+)\|([^]]*)\](\S*)", part)
            if m:
                inside = (m[2] + m[3]).split()
                words += inside
                tags += [TAGS.index(f"B-{m[1]}")] + [TAGS.index(f"I-{m[1]}")] * (len(inside) - 1)
            else:
                words += part.split()
                tags += [0] * len(part.split())
        out.append((words, tags))
    return out


class Field:
    """Feature weights by tag, and weights of one tag after another; row 0 of ``steps`` is the line's start."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    def emissions(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in lines])
        out = np.zeros((len(lines), int(lengths.max()), len(TAGS)))
        for i, words in enumerate(lines):
            for t, mine in enumerate(traits(words)):
                known = [self.names[f] for f in mine if f in self.names]
                out[i, t] = self.weights[known].sum(axis=0)
        return out, lengths

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each line, by Viterbi over all lines of the batch at once."""
        emit, lengths = self.emissions(lines)
        best = emit[:, 0] + self.steps[0]
        back = np.zeros(emit.shape, dtype=np.int8)
        final = best.copy()
        for t in range(1, emit.shape[1]):
            through = best[:, :, None] + self.steps[1:][None]
            back[:, t] = through.argmax(axis=1)
            best = through.max(axis=1) + emit[:, t]
            ends = lengths == t + 1
            final[ends] = best[ends]
        tag = final.argmax(axis=1)
        out = np.zeros(emit.shape[:2], dtype=np.int64)
        for t in range(emit.shape[1] - 1, -1, -1):
            inside = lengths > t
            out[inside, t] = tag[inside]
            move = inside & (t > 0)
            tag = np.where(move, back[np.arange(len(tag)), t, tag], tag)
        return [out[i, :n] for i, n in enumerate(lengths)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def train_field(rounds: int = 150) -> Field:
    """Gradient ascent (Adam) on the log-likelihood of the labelled table, by forward and backward sums."""
    rows = labelled_rows()
    seen = [traits(words) for words, _ in rows]
    names = {f: i for i, f in enumerate(sorted({f for line in seen for mine in line for f in mine}))}
    n, longest, tags = len(rows), max(len(w) for w, _ in rows), len(TAGS)
    lengths = np.array([len(w) for w, _ in rows])
    word, feature = [], []
    truth = np.zeros((n, longest), dtype=np.int64)
    for i, (line, (_, own)) in enumerate(zip(seen, rows, strict=True)):
        truth[i, : len(own)] = own
        for t, mine in enumerate(line):
            word += [i * longest + t] * len(mine)
            feature += [names[f] for f in mine]
    word, feature = np.array(word), np.array(feature)
    real = np.arange(longest)[None] < lengths[:, None]
    gold = np.eye(tags)[truth] * real[:, :, None]
    gold_steps = np.zeros((tags + 1, tags))
    np.add.at(gold_steps, (np.zeros(n, int), truth[:, 0]), 1)
    both = real[:, 1:]
    np.add.at(gold_steps, (truth[:, :-1][both] + 1, truth[:, 1:][both]), 1)
    weights, steps = np.zeros((len(names), tags)), np.zeros((tags + 1, tags))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, steps)]
    for k in range(1, rounds + 1):
        emit = np.zeros((n * longest, tags))
        np.add.at(emit, word, weights[feature])
        emit = emit.reshape(n, longest, tags)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + steps[0]
        for t in range(1, longest):
            new = _log_sum(ahead[:, t - 1, :, None] + steps[1:][None], 1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = _log_sum(ahead[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = _log_sum(steps[1:][None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], new, behind[:, t + 1])
        share = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        pull = (gold - share).reshape(n * longest, tags)
        slope_w = np.zeros_like(weights)
        np.add.at(slope_w, feature, pull[word])
        expected = np.zeros_like(steps)
        expected[0] = share[:, 0].sum(axis=0)
        for t in range(1, longest):
            pair = ahead[:, t - 1, :, None] + steps[1:][None] + (emit[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
            expected[1:] += (np.exp(pair) * real[:, t, None, None]).sum(axis=0)
        for p, slope, (first, second) in zip((weights, steps), (slope_w - 0.02 * weights, gold_steps - expected - 0.02 * steps), state, strict=True):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            p += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    # An I tag only follows a B or I of its kind.
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            allowed = [1 + TAGS.index(f"{p}-{tag[2:]}") for p in "BI"]
            steps[[i for i in range(tags + 1) if i not in allowed], j] = -1e6
    return Field(names, weights, steps)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_PROPER = {
    "email": lambda s: "@" in s.strip("@"),
    "ip": lambda s: len(re.findall(r"[0-9]+", s)) >= 4,
    "card": lambda s: 13 <= len(d := _NOT_DIGIT.sub("", s)) <= 19 and luhn(d),
    "phone": lambda s: 7 <= len(_NOT_DIGIT.sub("", s)) <= 15,
}


def _marked_lines(text: str) -> Iterator[tuple[int, str]]:
    """Start and content of each line that holds a digit or ``@``."""
    at = 0
    while m := _MARKED.search(text, at):
        start = text.rfind("\n", 0, m.start()) + 1
        stop = text.find("\n", m.end())
        stop = len(text) if stop < 0 else stop
        yield start, text[start:stop]
        at = stop


def field_spans(field: Field, texts: list[str], batch_words: int = 20_000) -> list[list[tuple[str, int, int]]]:
    """The spans that the field finds in each text; lines are decoded in batches of like length."""
    lines = [(i, start, list(_WORD.finditer(line))) for i, text in enumerate(texts) for start, line in _marked_lines(text)]
    lines.sort(key=lambda x: len(x[2]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(lines):
        stop = at + 1
        while stop < len(lines) and (stop + 1 - at) * len(lines[stop][2]) <= batch_words:
            stop += 1
        tagged = field.decode([[m.group() for m in words] for _, _, words in lines[at:stop]])
        for (i, start, words), tags in zip(lines[at:stop], tagged, strict=True):
            for kind, a, b in _tagged_runs(tags):
                found = texts[i][start + words[a].start() : start + words[b].end()]
                left = len(found) - len(found.lstrip("\"'|,;:!?[<"))
                right = len(found.rstrip(".,;:!?\"'|]>"))
                if left < right and _PROPER[kind](found[left:right]):
                    base = start + words[a].start()
                    out[i].append((kind, base + left, base + right))
        at = stop
    return out


def _tagged_runs(tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Kind, first and last word of each tagged span."""
    at = 0
    while at < len(tags):
        if not tags[at]:
            at += 1
            continue
        kind, stop = TAGS[tags[at]][2:], at
        while stop + 1 < len(tags) and TAGS[tags[stop + 1]] == f"I-{kind}":
            stop += 1
        yield kind, at, stop
        at = stop + 1


def all_spans(field: Field, texts: list[str]) -> Iterator[tuple[list, list]]:
    """For each text the base spans, and these with the field's spans that overlap none of them."""
    for text, added in zip(texts, field_spans(field, texts), strict=True):
        base = base_spans(text)
        # Of the base spans that begin before a span's end, the one that reaches furthest decides.
        starts = sorted((a, b) for _, a, b in base)
        reach = list(accumulate((b for _, b in starts), max))
        new = []
        for s in added:
            before = bisect_left(starts, (s[2],))
            if not before or reach[before - 1] <= s[1]:
                new.append(s)
        yield base, sorted(base + new, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _in_parts(texts: pa.Array, size: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Only texts with a digit or ``@`` are looked at word by word; others are passed as empty."""
    marked = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
    for at in range(0, len(texts), size):
        part = texts.slice(at, size)
        yield at, [v.as_py() if m else "" for v, m in zip(part, marked[at : at + size], strict=True)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans as text."""
    trained = train_field()
    model = (trained.names, trained.weights, trained.steps)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred features

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for batch in batches:
            for at, texts in _in_parts(batch.column(1)):
                rows = []
                for base, both in all_spans(field, texts):
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append((*counts, sha256(written(base).encode()).hexdigest(), written(both)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *arrays], names=names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return id_and_text(docs, id_col, text_col).mapInArrow(work, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with every span masked; a text without one, or null, is unchanged."""
    trained = train_field()
    model = (trained.names, trained.weights, trained.steps)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for batch in batches:
            old = batch.column(place)
            new: list[str | None] = []
            for at, texts in _in_parts(pc.fill_null(old, "")):
                found = [masked(t, both) if both else None for t, (_, both) in zip(texts, all_spans(field, texts), strict=True)]
                new += [old[at + i].as_py() if f is None else f for i, f in enumerate(found)]
            columns = batch.columns
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    unnamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return unnamed.mapInArrow(work, unnamed.schema).select(*[F.col(n) for n in unnamed.columns]).toDF(*docs.columns)
