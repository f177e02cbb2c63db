"""PII (6): fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained on a small table of labelled phrases, written apart from the
patterns: forms that they do not take (phones without a plus, cards with a wrong check digit, addresses in words,
secrets), forms that they do, and numbers, dates, names and versions that are nobody's data. It adds spans that meet
no base span. Only words near a digit, '@' or domain can be part of a span in the model, so the chain falls apart
into segments, exactly; segments of equal length are decoded together by Viterbi in numpy.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.store import prepare, turn_to
from gridspark.llm.words import Words, text_chunks

#: Kinds of base spans, and those that the field adds.
KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")
FEATURES = 1 << 13
#: What the field must prefer a kind by, over no kind, before it adds a span.
MARGIN = 0.0
#: Words that belong to a segment before and after one with a digit, '@' or domain.
BEFORE, AFTER = 3, 1
#: Versions of every labelled phrase, with other letters and digits in the places of its signs.
VERSIONS = 6

# The labelled table. [kind|..] is a span; # stands for a digit, % for a letter, ~ for a hexadecimal
# digit, ^ for a capital or digit, {o} for a number up to 255.
LABELLED = [
    "write to [email|%%%%.%%%%%%@%%%%%%%.org] for details", "mail me at [email|%%%%%##@mail#.example.com] soon", "contact: [email|%%_%%%@%%%%.co.uk], please",
    "[email|%%%%%%@%%%%%%.%%]", "mail [email|%%%% at %%%%%%%.org] today", "email [email|%%%%%% at %%%%%.com]", "[email|%%%% at %%%%%%%.org]", "contact [email|%%%%%%% at %%%%%.net] or call",
    "ask [email|%%%% at %%%%%%.de]", "call [phone|+# (###) ###-####] now", "%%%%, [phone|+# (###) 555-####] %%%% %%%", "[phone|(###) ###-####]", "%%%% %%% [phone|(###) ###-####] %%%%",
    "call [phone|###-###-####] after", "phone [phone|0## #######]", "tel. [phone|0## ### ####],", "[phone|030 #######]", "[phone|0## #######] %%%%", "Tel: [phone|0# ## ## ## ##]", "Fax [phone|0####/######]",
    "fax: [phone|###.###.####]", "mobile [phone|07### ######]", "dial [phone|00## ## ########]", "ring [phone|+## ### #######] now", "[phone|+## ## ### ## ##]", "call [phone|1-###-###-####] free", "[phone|+## ##########]",
    "from [ip|{o}.{o}.{o}.{o}] at", "host [ip|{o}.{o}.{o}.{o}]", "%%%% [ip|{o}.{o}.{o}.{o}] %%%%", "login from [ip|{o}.{o}.{o}.{o}], failed", "[ip|{o}.{o}.{o}.{o}]", "ping [ip|{o}.{o}.0.1]",
    "card [card|#### #### #### ####]", "paid with [card|################] on", "%%%% %%%% [card|################] %%%% %%%", "visa [card|4###-####-####-####],", "amex [card|37## ###### #####]",
    "[card|################]", "%%%%% [card|5### #### #### ####] %%%", "number [card|4###############].", "%%%, [card|################] [card|################] %%%",
    'token = "[secret|~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~]"', 'token = "[secret|~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~]"### %%%%', 'api_key = "[secret|~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~]"',
    "api key: [secret|%%##%%##%%##%%##%%##]", "secret: [secret|~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~]", "password: [secret|%%%%##%%]", "password = [secret|%#%%%#%%#]", "key = [secret|AKIA^^^^^^^^^^^^^^#^]",
    "access key [secret|AKIA#^^^^^^^^^^^^^^^]", "bearer [secret|~~~~~~~~##~~~~~~~~~~~~~~~~]", 'secret = "[secret|%%##%%%#%%%%##%%]"',
    "in 20## the", "since 19## and", "page ## of ###", "on ##.##.20## at", "20##-##-##", "##/##/20##", "at ##:## on", "version #.#.#", "v#.##.#", "release #.#.#.#", "Version #.#.#.# of the", "ISBN 978-#-###-#####-#",
    "order no. ########", "order ##########", "id ##########", "10.0.0.3##", "{o}.{o}.{o}.9##", "3##.{o}.{o}.{o}", "a@b", "%@%", "@%%%%%% wrote", "x @ y", "%%%%@%%%%", "$#,###.##", "### ###", "## %%%%", "section #.#.# says",
    "####################", "%%%% ######################", "#.####e-##", "commit ~~~~~~#", "chapter ##", "##.# degrees", "#### units", "lines ###-###", "score ##-##", "#,###,### people", "code ##### Berlin", "###px", "no. ###", "(###)",
    "%%%% ## %%%% ### %%%", "#", "##", "###", "####", "#####", "######", "#######", "########", "#st", "##th century", "see %%%%.%%%", "file %%%%%.txt", "www.%%%%%.com", "visit %%%%%%.org now", "hosted at %%%%%%.org", "looked at %%%%%.com",
    "available at %%%%%%%.net", "found at www.%%%%.org", "posted at %%%%.com", "published at %%%%%.org", "look at #", "room ###", "tel aviv ####", "token ##", "the card ##", "call ##", "phone ##", "password", "key #", "%%%%.%%%%% %%%%",
    "##%", "##$", "§ ##", "##-##", "###-###", "##.##", "#.#", "#/#", "#:#", "chapter #, page ##", "%%%#", "%%##%%", "ABC-####", "^^-####-^^", "http://%%%%.%%%/##", "https://www.%%%%.com/%%%/####", "ISBN ##########", "doi:##.####/%%%%.##",
]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does; runs are never given back, so a long run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each '@': the local part is the run before it, which no earlier match has taken."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order of start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape(word: str) -> str:
    return "".join("d" if "0" <= c <= "9" else ("X" if c.isupper() else "x") if c.isalpha() else c for c in word)


def cue(word: str) -> str:
    """A word as context: itself without case and signs around it, if the labelled table has it as a plain word."""
    plain = word[:24].strip(".,:;!?()[]\"'").lower() if len(word) <= 24 else ""
    return plain if plain in _CUES else ""


_PLACES = re.compile(r"[#%~^{}|\[\]0-9@./]")
_CUES = frozenset(w.strip(".,:;!?()[]\"'").lower() for phrase in LABELLED for w in re.sub(r"\[\w+\||\]", " ", phrase).split() if not _PLACES.search(w.strip(".,:;!?()[]\"'"))) - {""}


def _own_features(word: str) -> list[int]:
    """Hashed features of a word alone: its shape from both ends, its runs, its digits as a whole."""
    shape = _shape(word) if len(word) <= 64 else _shape(word[:32]) + "~" + _shape(word[-32:])
    runs = re.sub(r"(.)\1+", r"\1", shape)
    digits = _NOT_DIGIT.sub("", word)
    groups = re.findall(r"[0-9]+", word)
    letters = len(word) - len(digits)
    dotted = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", word.strip(".,;:!?()\"'#$%&"))
    names = [f"s:{runs[:24]}", f"f:{shape[:16]}", f"b:{shape[-16:]}", f"n:{min(len(digits), 21)}", f"a:{word.count('@')}:{bool(_DOMAIN.search(word))}", f"e:{shape[:1]}:{shape[-1:]}", f"g:{min(len(groups), 6)}",
             f"q:{len(groups) == 1}:{min(len(digits), 21)}:{letters > 4}", f"p:{bool(dotted) and all(len(g) <= 3 and int(g) <= 255 for g in groups)}:{bool(dotted)}", f"r:{runs[:24]}:{min(len(digits), 21)}",
             f"x:{bool(digits) and letters > 0 and word.strip(_SIGNS).isalnum()}:{min(len(word) // 8, 6)}", f"w:{cue(word)}"]
    return [crc32(x.encode()) % FEATURES for x in names]


_SIGNS = ".,;:!?()[]{}<>\"'#$%&="


def word_features(word: str, one: str = "", two: str = "") -> list[int]:
    """Hashed features of a word after the words `one` (the last) and `two` (before it)."""
    return [*_own_features(word), crc32(f"1:{cue(one)}".encode()) % FEATURES, crc32(f"2:{cue(two)}:{cue(one)}".encode()) % FEATURES]


N_FEATURES = 14


class Segments:
    """Runs of words near a digit, '@' or domain in a run of texts: `doc`, first and last word of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets)
        lower = (data >= 97) & (data <= 122)
        domain = np.zeros(len(data), bool)
        domain[1:-1] = (data[1:-1] == 46) & lower[:-2] & lower[2:]
        marks = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)) | domain)])
        marked = marks[words.end] > marks[words.start]
        near = marked.copy()
        for step in range(1, BEFORE + 1):
            near[:-step] |= marked[step:] & (words.doc[step:] == words.doc[:-step])
        for step in range(1, AFTER + 1):
            near[step:] |= marked[:-step] & (words.doc[step:] == words.doc[:-step])
        before = np.zeros(len(words), bool)
        before[1:] = near[:-1] & (words.doc[1:] == words.doc[:-1])
        after = np.zeros(len(words), bool)
        after[:-1] = near[1:] & (words.doc[1:] == words.doc[:-1])
        self.first, self.last = np.flatnonzero(near & ~before), np.flatnonzero(near & ~after)
        self.doc = words.doc[self.first]
        # bytes to code points
        self.points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def place(self, word: int) -> tuple[int, int]:
        words = self.words
        zero = self.points[words.offsets[words.doc[word]]]
        return int(self.points[words.start[word]] - zero), int(self.points[words.end[word]] - zero)

    def features(self, segment: int) -> list[list[int]]:
        words, one, two, out = self.words, "", "", []
        for w in range(self.first[segment], self.last[segment] + 1):
            word = words.data[words.start[w]:words.end[w]].tobytes().decode()
            out.append(_features_of(word, one, two))
            one, two = word, one
        return out


_seen: dict[str, tuple[list[int], str]] = {}
_context: dict[tuple[str, str], list[int]] = {}


def _forget() -> None:
    _seen.clear()
    _context.clear()


def _features_of(word: str, one: str, two: str) -> list[int]:
    """`word_features`, remembered by word and by context."""
    if len(_seen) > 100_000:
        _seen.clear()
    for w in (word, one, two):
        if w not in _seen:
            _seen[w] = (_own_features(w), cue(w))
    context = _seen[one][1], _seen[two][1]
    if context not in _context:
        _context[context] = word_features("", *context)[-2:]
    return [*_seen[word][0], *_context[context]]


def labelled_phrases(phrases: list[str] = LABELLED, versions: int = VERSIONS, seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans as (start, kind, end)) of every version of every phrase, each with the same random choices every time."""
    rng, out = random.Random(seed), []
    signs = {"#": "0123456789", "%": "abcdefghijklmnopqrstuvwxyz", "~": "0123456789abcdef", "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    for phrase in phrases:
        for _ in range(versions):
            filled, text, spans = re.sub(r"\{o\}", lambda m: str(rng.randint(0, 255)), phrase), "", []
            for part in re.split(r"(\[\w+\|[^\]]*\])", filled):
                kind, _, body = part[1:-1].partition("|") if part.startswith("[") and "|" in part else ("", "", part)
                body = "".join(rng.choice(signs[c]) if c in signs else c for c in body)
                if kind:
                    spans.append((len(text), ADDED.index(kind), len(text) + len(body)))
                text += body
            out.append((text, spans))
    return out


def _examples(phrases: list[tuple[str, list[tuple[int, int, int]]]]) -> list[tuple[list[int], list[int], int]]:
    """(features, labels, 1) of every segment of labelled texts; a word is labelled 1 + the kind of the span that it meets."""
    rows = []
    for text, spans in phrases:
        raw = text.encode()
        found = Segments(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for s in range(len(found.first)):
            places = [found.place(w) for w in range(found.first[s], found.last[s] + 1)]
            labels = [next((1 + kind for a, kind, b in spans if a < end and start < b), 0) for start, end in places]
            rows.append(([f for features in found.features(s) for f in features], labels, 1))
    return rows


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of features by label and of neighbouring labels."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def gradient(self, features: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of segments of one length, by forward-backward."""
        scores = self.emit[features].sum(axis=2)
        rows, length, k = scores.shape
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, length):
            ahead[:, t] = scores[:, t] + _log_sum(ahead[:, t - 1, :, None] + self.step, 1)
        for t in range(length - 2, -1, -1):
            back[:, t] = _log_sum(self.step + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = _log_sum(ahead[:, -1], 1)
        error = np.eye(k)[labels] - np.exp(ahead + back - total[:, None, None])
        emit, step = np.zeros_like(self.emit), np.zeros_like(self.step)
        np.add.at(emit, features, (error * n[:, None, None])[:, :, None, :])
        for t in range(1, length):
            both = np.exp(ahead[:, t - 1, :, None] + self.step + (scores[:, t] + back[:, t])[:, None, :] - total[:, None, None])
            step -= (both * n[:, None, None]).sum(axis=0)
            np.add.at(step, (labels[:, t - 1], labels[:, t]), n)
        return emit, step

    def decode(self, features: np.ndarray, margin: float = MARGIN) -> np.ndarray:
        """The best labels of segments of one length."""
        scores = self.emit[features].sum(axis=2)
        scores[:, :, 0] += margin
        rows, length, _ = scores.shape
        best, came = scores[:, 0], []
        for t in range(1, length):
            ways = best[:, :, None] + self.step
            came.append(ways.argmax(axis=1))
            best = scores[:, t] + ways.max(axis=1)
        out = np.empty((rows, length), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(length - 2, -1, -1):
            out[:, t] = came[t][np.arange(rows), out[:, t + 1]]
        return out


def fit(table: list[tuple[list[int], list[int], int]], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """A field fitted to (features, labels, count) by Adam on all segments at once; an empty table labels nothing."""
    k = len(ADDED) + 1
    field = Field(np.zeros((FEATURES, k)), np.zeros((k, k)))
    groups: dict[int, list] = defaultdict(list)
    for features, labels, n in table:
        groups[len(labels)].append((features, labels, n))
    tensors = [(np.array([f for f, _, _ in g]).reshape(len(g), length, N_FEATURES), np.array([x for _, x, _ in g]), np.array([n for _, _, n in g], float))
               for length, g in sorted(groups.items())]
    total = sum(n.sum() for _, _, n in tensors) or 1.0
    weights = [field.emit, field.step]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        sums = [np.zeros_like(w) for w in weights]
        for tensor in tensors:
            for s, g in zip(sums, field.gradient(*tensor)):
                s += g
        for i, (w, s) in enumerate(zip(weights, sums)):
            g = decay * w - s / total
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if not tensors:
        field.emit[:, 0] = 1.0
    return field


def train(phrases: list[str] = LABELLED) -> Field:
    """A field fitted to the labelled table; without phrases it labels nothing."""
    return fit(_examples(labelled_phrases(phrases)))


def _joined(kind: int, span: str, word: str) -> bool:
    """Whether a word goes on with the span of its kind that it follows."""
    digits = len(_NOT_DIGIT.sub("", span)) + len(_NOT_DIGIT.sub("", word))
    if ADDED[kind] == "email":
        return "@" not in word and not _DOMAIN.search(span)
    return {"phone": digits <= 15 and not word.startswith("+"), "card": digits <= 19}.get(ADDED[kind], False)


def _added(found: Segments, data: np.ndarray, field: Field, texts: dict[int, str], base: dict[int, list]) -> dict[int, list]:
    """Spans that the field adds: words of one kind that belong together, trimmed, that meet no base span."""
    groups: dict[int, list[int]] = defaultdict(list)
    for s, length in enumerate(found.last - found.first + 1):
        groups[int(length)].append(s)
    out: dict[int, list] = defaultdict(list)
    for length, members in groups.items():
        labels = field.decode(np.array([found.features(s) for s in members]).reshape(len(members), length, N_FEATURES))
        for i in np.flatnonzero(labels.any(axis=1)):
            s, row = members[i], labels[i]
            doc, t = int(found.doc[s]), 0
            text = texts[doc]
            while t < length:
                end = t
                if row[t]:
                    a, b = found.place(found.first[s] + t)
                    while end + 1 < length and row[end + 1] == row[t]:
                        start, stop = found.place(found.first[s] + end + 1)
                        if not _joined(int(row[t]) - 1, text[a:b], text[start:stop]):
                            break
                        b, end = stop, end + 1
                    while a < b and not (text[a].isalnum() or text[a] in "+("):
                        a += 1
                    while b > a and not text[b - 1].isalnum():
                        b -= 1
                    if a < b and _holds(int(row[t]) - 1, text[a:b]) and not any(x < b and a < y for x, _, y in base[doc]):
                        out[doc].append((a, int(row[t]) - 1, b))
                t = end + 1
    return out


def _holds(kind: int, span: str) -> bool:
    """Whether a span has what every one of its kind has: digits enough, or a domain."""
    digits = len(_NOT_DIGIT.sub("", span))
    return {"phone": 6 <= digits <= 15, "card": 14 <= digits <= 19, "email": bool(_DOMAIN.search(span)), "ip": digits >= 4}.get(ADDED[kind], len(span) >= 6)


def spans_of(column: pa.Array, field: Field) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of each text of a column; a null has none."""
    for _, _, data, offsets in text_chunks(column):
        found = Segments(data, offsets)
        texts = {int(d): data[offsets[d]:offsets[d + 1]].tobytes().decode() for d in np.unique(found.doc)}
        base = {d: base_spans(t) for d, t in texts.items()}
        added = _added(found, data, field, texts, base)
        for d in range(len(offsets) - 1):
            yield base.get(d, []), added.get(d, [])


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans): every span's kind, start and end in code points, and whether a pattern gave it; by start, then kind.

    Null and empty texts have no spans. Rows repeated get equal spans, a null doc_id stays null. Other columns are not
    read. Texts are read whole, a few megabytes at a time, one text at least; labels that are equally likely go to
    the kind listed first.
    """
    prepare(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pii", _forget)
        for batch in batches:
            rows = [[{"kind": ADDED[k], "start": a, "end": b, "base": own} for a, k, b, own in sorted([(*s, True) for s in base] + [(*s, False) for s in added])]
                    for base, added in spans_of(batch.column(1), field)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first one names them all."""
    out, free = [], 0
    for a, kind, b in sorted(spans):
        if a >= free:
            out += [text[free:a], f"[{ADDED[kind].upper()}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with the personal data in `text` replaced; `n_chars`, where there is one, is counted anew. Null stays null."""
    prepare(docs.sparkSession)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pii", _forget)
        for batch in batches:
            changed = list(batch.columns)
            texts = batch.column(at).to_pylist()
            for i, (base, added) in enumerate(spans_of(batch.column(at), field)):
                if base or added:
                    texts[i] = hide(texts[i], base + added)
            changed[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(changed, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
