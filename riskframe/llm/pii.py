"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import Shared, first_by_hash

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
HIDDEN = 24
#: Labelled windows that the model is trained on, by hash order: the documented bound of its sample.
TRAIN_DOCUMENTS = 1500
TRAIN_WINDOWS = 4096
PASSES = 8
STEPS, BATCH = 480, 64
#: Windows decoded at once.
BATCH_WINDOWS = 4096
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

# Base patterns ----------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern.  Its first part can only be the run of its characters before an @ sign, so the text
    is read from sign to sign, in time proportional to its length."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        domain = _DOMAIN.match(text, sign)
        if domain:
            start = sign
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < sign:
                done = domain.end()
                yield start, done
        sign = text.find("@", sign + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip pattern: every four parts in a chain of dotted numbers; kept if all parts are at most 255."""
    for chain in _DOTTED.finditer(text):
        parts = list(re.finditer("[0-9]+", chain.group()))
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield chain.start() + parts[i].start(), chain.start() + parts[i + 3].end()


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _DIGITS.finditer(text):
        digits = _digits(found.group()) if found.end() - found.start() <= 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= len(_digits(found.group())) <= 15:
                yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """All base matches as (kind, start, end), by kind and start."""
    if not _MARKED.search(text):
        return []
    return [(k, a, b) for k, find in enumerate((emails, addresses, cards, phones)) for a, b in find(text)]


_MARKED = re.compile("[@0-9]")


def plausible(kind: int, text: str) -> bool:
    """What a span of the model must look like to be personal data of its kind; each needs an @ sign or a digit."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"\S+\s?@\s?[^\s@]+(?:\s?\.\s?[^\s@.]+)+", text)) and len(text) <= WINDOW - STRIDE
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and bool(re.fullmatch(r"[0-9. ]+", text))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9 .-]+", text))
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text)) and len(digits) < len(text)


# The model ----------------------------------------------------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Class of a code point below 0x3000: ASCII marks are their own, letters and digits are merged by kind."""
    table = np.full(0x3000, 5, np.int8)
    for c in range(0x3000):
        char = chr(c)
        if char.isascii() and char.isdigit():
            table[c] = 0
        elif char.isascii() and char.islower():
            table[c] = 1
        elif char.isascii() and char.isupper():
            table[c] = 2
        elif char.isspace():
            table[c] = 3 if char == " " else 4
        elif char.isalpha():
            table[c] = 6
        elif 33 <= c < 127:
            table[c] = 8 + "@.+-()_%/:,;#=".find(char) + 1
    return table


_CLASS = _classes()
CLASSES = 24
PADDING = 7


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x3000, _CLASS[np.minimum(codes, 0x2FFF)], 6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Two LSTMs over character classes, one each way, a linear layer to tags, and a transition matrix."""

    def __init__(self, rng: np.random.Generator):
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "next": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            # One-hot input, so its weights are looked up; the forget gate begins open.
            self.p |= {f"in_{way}": draw(CLASSES, 4 * HIDDEN), f"h_{way}": draw(HIDDEN, 4 * HIDDEN)}
            self.p[f"in_{way}"][:, HIDDEN : 2 * HIDDEN] += 1

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of a batch of windows, one step for all windows at a time."""
        steps = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        for t in steps:
            gates = self.p[f"in_{way}"][x[:, t]] + h @ self.p[f"h_{way}"]
            ifo = _sigmoid(gates[:, : 3 * HIDDEN])
            g = np.tanh(gates[:, 3 * HIDDEN :])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, tc, h_before))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2) @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the right tags under the CRF."""
        kept = {"f": [], "b": []}
        states = np.concatenate([self._run(x, way, kept[way]) for way in "fb"], axis=2)
        scores = states @ self.p["out"] + self.p["bias"]
        shares, pairs = _marginals(scores, self.p["next"])
        n, steps = x.shape
        error = shares
        np.add.at(error, (np.arange(n)[:, None], np.arange(steps)[None, :], y), -1)
        error /= n
        np.add.at(pairs, (y[:, :-1], y[:, 1:]), -1)
        grads = {"next": pairs / n, "out": np.einsum("nth,ntk->hk", states, error), "bias": error.sum((0, 1))}
        back = error @ self.p["out"].T
        for w, way in enumerate("fb"):
            own = back[:, :, w * HIDDEN : (w + 1) * HIDDEN]
            given, held, all_gates = [], [], []
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            for t, i, f, o, g, before, tc, h_before in reversed(kept[way]):
                dh = dh + own[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                given.append(x[:, t])
                held.append(h_before)
                all_gates.append(gates)
                dh, dc = gates @ self.p[f"h_{way}"].T, dc * f
            gates = np.concatenate(all_gates)
            one_hot = (np.concatenate(given)[:, None] == np.arange(CLASSES)).astype(np.float32)
            grads |= {f"in_{way}": one_hot.T @ gates, f"h_{way}": np.concatenate(held).T @ gates}
        return grads

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags of each window under emissions and transitions."""
        scores = self.emissions(x)
        n, steps, _ = scores.shape
        best, via = scores[:, 0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            total = best[:, :, None] + self.p["next"]
            via[t] = total.argmax(axis=1)
            best = total.max(axis=1) + scores[:, t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = via[t][np.arange(n), tags[:, t]]
        return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _marginals(scores: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each tag at each place, and expected numbers of each transition, by forward and backward sums."""
    n, steps, _ = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, steps):
        ahead[:, t] = _lse(ahead[:, t - 1][:, :, None] + step, 1) + scores[:, t]
    for t in range(steps - 2, -1, -1):
        behind[:, t] = _lse(step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    whole = _lse(ahead[:, -1], 1)
    shares = np.exp(ahead + behind - whole[:, None, None])
    joint = ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    return shares, np.exp(joint).sum((0, 1))


def _varied(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A labelled text whose spans are written otherwise half of the time: spaces about marks, other separators."""
    out, made, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        span = text[a:b]
        if rng.random() < 0.5:
            if kind == 0:
                span = span.replace("@", " @ ") if rng.random() < 0.5 else re.sub(r"\.(?=[^.]*$)", " . ", span)
            elif kind == 1:
                span = span.replace(".", " . ")
            elif kind == 2:
                span = rng.choice([" ", "-", "."]).join(_digits(span)[i : i + 4] for i in range(0, len(_digits(span)), 4))
            else:
                span = rng.choice([span.lstrip("+"), re.sub(r"^\+\S+ ", "", span)])
        out += text[at:a]
        made.append((kind, len(out), len(out) + len(span)))
        out, at = out + span, b
    return out + text[at:], made


def train_tagger(texts: list[str]) -> Tagger:
    """Learn from the base spans of the texts given: windows around spans, as they are or varied, and windows without any.

    Without a span in the sample nothing is learned, and the untrained tagger is marked so that it adds nothing.
    """
    rng = np.random.default_rng(5)
    rows, tags = [], []
    spans_of = [base_spans(text) for text in texts]
    # A small sample is read again, up to PASSES times, with other windows and other ways of writing its spans.
    repeats = min(PASSES, 1 + TRAIN_WINDOWS // max(1, 2 * sum(map(len, spans_of))))
    for text, spans in zip(texts * repeats, spans_of * repeats, strict=True):
        text, spans = _varied(text, spans, rng)
        codes, labels = _codes(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            labels[a:b] = 2 + 2 * kind
            labels[a] = 1 + 2 * kind
        wanted = [max(0, int(a - rng.integers(0, WINDOW // 2))) for _, a, _ in spans]
        marked = np.flatnonzero(codes == 0)
        wanted += [max(0, int(rng.choice(marked) - rng.integers(0, WINDOW)))] if len(marked) else []
        wanted += [int(rng.integers(0, max(1, len(text) - WINDOW)))] if rng.random() < 0.3 else []
        for start in wanted:
            row, tag = np.full(WINDOW, PADDING), np.zeros(WINDOW, np.int64)
            part = codes[start : start + WINDOW]
            row[: len(part)], tag[: len(part)] = part, labels[start : start + WINDOW]
            rows.append(row)
            tags.append(tag)
    tagger = Tagger(rng)
    tagger.trained = any(t.any() for t in tags)
    if not tagger.trained:
        return tagger
    chosen = rng.permutation(len(rows))[:TRAIN_WINDOWS]
    x, y = np.stack(rows)[chosen], np.stack(tags)[chosen]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.p.items()}
    step = 0
    while step < STEPS:
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            step += 1
            grads = tagger.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                m, v = moments[k]
                g = g * min(1.0, 5 / (norm + 1e-9))
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                rate = 0.02 * max(0.05, 1 - step / (STEPS + 1))
                tagger.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


# Whole texts ----------------------------------------------------------------------------------------------------------------


def _window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the overlapping windows that hold a digit or an @ sign.

    A span of the model needs one of them (``plausible``), so the other windows could not add anything.
    """
    marked = np.flatnonzero((codes == 0) | (codes == _CLASS[ord("@")]))
    if not len(marked):
        return marked
    last = max(0, -(-(len(codes) - WINDOW) // STRIDE))
    slot = marked // STRIDE
    slots = np.unique(np.concatenate([slot, slot - 1]))
    return slots[(slots >= 0) & (slots <= last)] * STRIDE


def _found(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Spans of one window's tags as (kind, start, end)."""
    some, at = np.flatnonzero(tags), 0
    while at < len(some):
        start = some[at]
        kind, end = (tags[start] - 1) // 2, start + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        yield int(kind), int(start), int(end)
        at = np.searchsorted(some, end)


def _reconciled(text: str, base: list[tuple[int, int, int]], found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and of the model's spans those that are plausible and overlap none: longest first, then leftmost."""
    taken = sorted((a, b) for _, a, b in base)
    chosen = list(base)
    for kind, a, b in sorted(found, key=lambda s: (s[1] - s[2], s[1], s[0])):
        b = min(b, len(text))
        while a < b and text[a].isspace():
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        if a < b and plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
            # A number that goes on beyond the span is another number.
            if not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                taken.append((a, b))
                chosen.append((kind, a, b))
    return sorted(chosen)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _tagged(tagger: Tagger, texts: pd.Series) -> pd.DataFrame:
    base = [base_spans(t) if t else [] for t in texts]
    found: list[set] = [set() for _ in base]
    rows, owners = [], []

    def flush() -> None:
        if rows:
            for (i, start), tags in zip(owners, tagger.decode(np.stack(rows)), strict=True):
                found[i].update((k, start + a, start + b) for k, a, b in _found(tags))
            rows.clear()
            owners.clear()

    for i, text in enumerate(texts):
        if not text or not tagger.trained or not _MARKED.search(text):
            continue
        codes = _codes(text)
        for start in _window_starts(codes).tolist():
            row = np.full(WINDOW, PADDING)
            part = codes[start : start + WINDOW]
            row[: len(part)] = part
            rows.append(row)
            owners.append((i, start))
            if len(rows) == BATCH_WINDOWS:
                flush()
    flush()
    out = {f"n_{kind}": [sum(k == n for k, *_ in own) for own in base] for n, kind in enumerate(KINDS)}
    out["base_sha256"] = [hashlib.sha256(_named(own).encode()).hexdigest() for own in base]
    out["spans"] = [_named(_reconciled(t or "", own, more)) for t, own, more in zip(texts, base, found, strict=True)]
    return pd.DataFrame(out)


_RESULT = ", ".join([*[f"n_{kind} long" for kind in KINDS], "base_sha256 string", "spans string"])


def fit_tagger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Tagger:
    """Train on documents that hold a digit or an @ sign, the TRAIN_DOCUMENTS first by hash of key and text."""
    marked = docs.select(F.col(text).cast("string").alias("_text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_h")).where(F.col("_text").rlike("[@0-9]"))
    near = F.regexp_extract_all(F.col("_text"), F.lit("(?s).{0,160}[@0-9][@0-9 +().a-zA-Z-]{6}.{0,160}"), F.lit(0))
    drawn = first_by_hash(marked, TRAIN_DOCUMENTS).select("_h", F.slice(near, 1, 4).alias("parts")).orderBy("_h").collect()
    return train_tagger([part for row in drawn for part in row["parts"]])


def personal_data(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts of base spans by kind, ``base_sha256`` of them, and ``spans``: base spans and the model's.

    Every whole text is searched; null counts as empty.  Spans are ``kind:start:end`` in code points, by kind and start.
    Counts and digest are those of the base patterns, which the model never changes; it adds plausible spans that
    overlap none of them.  Repeated rows give repeated results.
    """
    shared = Shared(docs.sparkSession, tagger)

    @F.pandas_udf(_RESULT)
    def tagged(texts: pd.Series) -> pd.DataFrame:
        return _tagged(shared.value, texts)

    out = docs.select(F.col(key).alias("_key"), tagged(F.col(text).cast("string")).alias("_out"))
    return out.select(F.col("_key").alias(key), "_out.*")


def redacted(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """All rows and columns, every span of personal data replaced by its kind in angle brackets."""
    shared = Shared(docs.sparkSession, tagger)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _cut(t, s) for t, s in zip(texts, _tagged(shared.value, texts)["spans"], strict=True)], dtype=object)

    return docs.withColumn(text, clean(F.col(text).cast("string")))


def _cut(text: str, spans: str) -> str:
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: s[1]):
        if b > at:
            out += [text[at : max(at, a)], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]

