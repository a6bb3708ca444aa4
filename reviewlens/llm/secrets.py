"""Secret scans: patterns, and a linear-chain conditional random field for what they miss.

The patterns give base spans. The field tags tokens (runs of other characters than white space, quotes, commas,
semicolons and brackets; ``=`` and ``:`` end a token) as secret begin, inside or outside. Its features are a token's
shape, its neighbours' shapes and words, and the file: whether the text has code or configuration lines. It learns
from base spans of a bounded sample of documents (``SAMPLE`` with and ``SAMPLE`` without a span, by hash), whose
neighbours and file are hidden half of the time, so that the shape alone has to do. A tagged run of at least ``LEAST`` characters
with a mean lead over outside above ``margin`` becomes a span of the kind ``other`` unless it overlaps a base span.

Decoding is Viterbi over whole texts and all tokens. A token is left out of it only where no run of tags other than outside
that holds it can outweigh outside: the best path passes there anyway, and the stretches between such tokens are decoded one by one.

Cases: null texts are empty and have no spans; without base spans to learn from the field adds none; repeated ids
and all other columns pass unchanged but for one named ``spans``. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import arrays
from reviewlens.llm.spans import SPANS
from reviewlens.plans.sizing import materialise, small_side

KINDS = ("assign", "access", "hex", "other")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of the class that is long enough is found at its first character
TOKEN = re.compile(r"""[^\s"'`,;(){}\[\]<>=:|]+""")
MARK = re.compile(r"[0-9_+/\\$%@#&*~^]")
FILE = re.compile(r"(?m)^\s*(?:#include|import |def |class |export |var |let |const |\w+\s*[:=])")
WORDS = frozenset(("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "private", "access"))
LEAST, SAMPLE, WIDTH = 16, 2_000, 1 << 14
KNOWN = 500_000  # different tokens whose scores a task keeps
O, B, I = 0, 1, 2  # noqa: E741
NEVER = -1e9


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost spans of each pattern that do not overlap, failing matches dropped."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def entropy(token: str) -> float:
    """Bits per character of the token's own letter counts."""
    return -sum(c / len(token) * math.log2(c / len(token)) for c in Counter(token).values())


def shape(token: str) -> str:
    """Length class, character classes and evenness, as one name."""
    kinds = "".join(n for n, test in (("a", str.islower), ("A", str.isupper), ("0", str.isdigit)) if any(map(test, token)))
    if not token.isascii():
        kinds += "u"
    if any(not c.isalnum() for c in token):
        kinds += "." if re.search(r"[.@]\w", token) else "_"
    digits = sum(map(str.isdigit, token)) * 4 // len(token)
    return f"{min(len(token) // 4, 10)}{kinds}{digits}{int(entropy(token) * 2) if len(token) > 7 else 0}"


def features(tokens: list[str], at: int, in_file: bool, hide: bool = False) -> list[int]:
    """Feature numbers of a token: its shape, the words and shapes beside it, the file."""
    token = tokens[at]
    names = ["bias", f"s:{shape(token)}", f"l:{min(len(token) // 4, 10)}"]
    if hide:
        return [number(n) for n in names]
    names.append(f"f:{in_file}:{min(len(token) // 8, 4)}")
    for step in (-2, -1, 1):
        if 0 <= at + step < len(tokens):
            near = tokens[at + step].lower()
            names += [f"{step}k:{near.strip('-_.') in WORDS}", f"{step}l:{min(len(near) // 4, 6)}"]
        else:
            names.append(f"{step}:end")
    return [number(n) for n in names]


_numbers: dict[str, int] = {}


def number(name: str) -> int:
    """A number below ``WIDTH`` that is the same in every process."""
    if name not in _numbers:
        value = 2166136261
        for b in name.encode():
            value = (value ^ b) * 16777619 & 0xFFFFFFFF
        _numbers[name] = (value ^ value >> 15) % WIDTH
    return _numbers[name]


class Field:
    """Weights per feature and tag, and per pair of tags."""

    def __init__(self):
        self.state, self.moves = np.zeros((WIDTH, 3)), np.zeros((3, 3))
        self.learned = False
        self.forget()

    def forget(self) -> None:
        """Drop what is kept of tokens; for changed weights."""
        self.known: dict[str, int] | None = None
        self.rows: dict[tuple, int] = {}
        self.kinds: dict[tuple, np.ndarray] = {}
        self.table = np.zeros((0, 5, 3))

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        return np.stack([self.state[r].sum(0) for r in rows]) if rows else np.zeros((0, 3))

    def _moves(self) -> np.ndarray:
        moves = self.moves.copy()
        moves[O, I] = NEVER  # inside follows begin or inside
        return moves

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of a stretch between two tokens that are outside."""
        moves, best, back = self._moves(), None, []
        for row in scores:
            if best is None:
                best = moves[O] + row
            else:
                paths = best[:, None] + moves
                back.append(paths.argmax(0))
                best = paths.max(0) + row
        tags = [int((best + moves[:, O]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def fit(self, sequences: list[tuple[list[list[int]], list[int]]], turns: int = 8, rate: float = 0.2, decay: float = 1e-4) -> None:
        """Maximise the conditional likelihood by stochastic gradients (AdaGrad); forward and backward sums."""
        self.learned = any(any(tags) for _, tags in sequences)
        self.forget()
        if not self.learned:
            return
        seen, seen_moves = np.full((WIDTH, 3), 1e-6), np.full((3, 3), 1e-6)
        mix = np.random.default_rng(0)
        for _ in range(turns):
            for at in mix.permutation(len(sequences)):
                rows, tags = sequences[at]
                scores, moves = self.emissions(rows), self._moves()
                n = len(rows)
                ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
                ahead[0] = moves[O] + scores[0]
                for t in range(1, n):
                    ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + moves, axis=0) + scores[t]
                behind[-1] = moves[:, O]
                for t in range(n - 2, -1, -1):
                    behind[t] = np.logaddexp.reduce(moves + (scores[t + 1] + behind[t + 1]), axis=1)
                whole = np.logaddexp.reduce(ahead[-1] + behind[-1])
                grad = np.exp(ahead + behind - whole)
                grad[np.arange(n), tags] -= 1
                pairs = np.zeros((3, 3))
                for t in range(n - 1):
                    pairs += np.exp(ahead[t][:, None] + moves + scores[t + 1] + behind[t + 1] - whole)
                    pairs[tags[t], tags[t + 1]] -= 1
                for t, row in enumerate(rows):
                    for f in row:
                        step = grad[t] + decay * self.state[f]
                        seen[f] += step**2
                        self.state[f] -= rate * step / np.sqrt(seen[f])
                seen_moves += pairs**2
                self.moves -= rate * pairs / np.sqrt(seen_moves)

    def scores(self, tokens: list[str], in_file: bool) -> np.ndarray:
        """:meth:`emissions` of the :func:`features` of all tokens, added up from what each token gives itself and its neighbours."""
        if self.known is None or len(self.known) > KNOWN:
            self.known = {}
        ids = [self.known.get(t, -1) for t in tokens]
        for i, t in enumerate(tokens):
            if ids[i] < 0:
                ids[i] = self.known[t] = self._kind(t)
        if len(self.table) <= len(self.kinds):
            end = [self.state[number(f"{step}:end")] for step in (-2, -1, 1)]
            self.table = np.stack([np.stack([*end[:2], *end]), *self.kinds.values()])  # the first row for a missing neighbour
        beside = np.zeros(len(tokens) + 3, np.int64)
        beside[2:-1] = ids
        return self.table[beside[2:-1], int(in_file)] + self.table[beside[:-3], 2] + self.table[beside[1:-2], 3] + self.table[beside[3:], 4]

    def _kind(self, token: str) -> int:
        """The row of the table for tokens with these features."""
        name, size = token.lower(), min(len(token), 40)
        kind = shape(token), size // 4, size // 8, name.strip("-_.") in WORDS, min(len(name) // 4, 6)
        if kind not in self.rows:
            # What such a token adds to its own scores, outside and inside a file, and to those of its neighbours behind, next and ahead.
            own = [self.state[features([token], 0, f)].sum(0) - sum(self.state[number(f"{step}:end")] for step in (-2, -1, 1)) for f in (False, True)]
            near = [self.state[number(f"{step}k:{kind[3]}")] + self.state[number(f"{step}l:{kind[4]}")] for step in (-2, -1, 1)]
            self.rows[kind] = len(self.kinds) + 1
            self.kinds[kind] = np.stack([*own, *near])
        return self.rows[kind]

    def open_tokens(self, scores: np.ndarray) -> np.ndarray:
        """Places of the tokens that may not be outside: a run of other tags that holds them may reach the score of outside."""
        moves = self._moves()
        # The most that a step into, inside or out of a run gains; a run of n tokens has n + 1 steps.
        step = max(moves[O, B], moves[1:, :].max()) - moves[O, O]
        gain = np.concatenate([[0.0], np.cumsum(scores[:, 1:].max(1) - scores[:, O] + step)])
        most = np.maximum.accumulate(gain[:0:-1])[::-1] - np.minimum.accumulate(gain[:-1])
        return np.flatnonzero(most + step >= -1e-6)

    def spans(self, text: str, margin: float) -> list[tuple[int, int]]:
        """Runs tagged as a secret."""
        marks = list(TOKEN.finditer(text)) if self.learned else []
        if not marks:
            return []
        scores = self.scores([m[0] for m in marks], FILE.search(text) is not None)
        live = self.open_tokens(scores).tolist()
        out, at = [], 0
        while at < len(live):
            to = at + 1
            while to < len(live) and live[to] == live[to - 1] + 1:
                to += 1
            part = scores[live[at] : live[to - 1] + 1]
            begin = None
            for k, tag in enumerate([*self.viterbi(part), O]):
                if begin is not None and tag != I:
                    first, last = marks[live[at + begin]], marks[live[at + k - 1]]
                    lead = np.mean(part[begin:k, 1:].max(1) - part[begin:k, O])
                    if last.end() - first.start() >= LEAST and lead > margin:
                        out.append((first.start(), last.end()))
                    begin = None
                if tag == B:
                    begin = k
            at = to
        return out


def _sequences(text: str, hide: bool) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Stretches of twelve tokens around base spans, and one elsewhere, with their tags."""
    spans = sorted((s, e) for _, s, e in base_spans(text))
    values = []
    for kind, s, e in base_spans(text):
        m = ASSIGN.match(text, s) if kind == "assign" else None
        values.append(m.span(2) if m else (s, e))
    marks = list(TOKEN.finditer(text))
    tokens, tags = [m[0] for m in marks], []
    before = None
    for m in marks:
        held = next((v for v in values if v[0] < m.end() and m.start() < v[1]), None) if values else None
        tags.append(O if held is None else I if held == before else B)
        before = held
    in_file = FILE.search(text) is not None
    centres = [i for i, t in enumerate(tags) if t == B]
    if not centres and tokens:
        # Tokens that look like one, and plain words.
        centres = sorted({*[i for i, t in enumerate(tokens) if len(t) >= 24 or MARK.search(t)][:3], len(tokens) // 2})
    done = 0
    for c in centres if spans else centres[:4]:
        a, b = max(done, c - 6), min(len(tokens), c + 7)
        if a < b:
            yield [features(tokens, i, in_file, hide) for i in range(a, b)], tags[a:b]
            done = b


def train(docs: DataFrame, *, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """Learn from base spans of a bounded sample of the documents."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    likely = F.col("text").rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    marked = materialise(rows.select("id", likely.alias("likely")))
    order = F.xxhash64("id", F.lit(7)), F.col("id")
    chosen = marked.where("likely").orderBy(*order).limit(sample).union(marked.where("NOT likely").orderBy(*order).limit(sample))
    chosen = materialise(chosen.select("id").distinct())
    texts = rows.join(small_side(chosen), "id", "left_semi").withColumn("hide", F.pmod(F.xxhash64("id"), F.lit(2)) == 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                found = [(i, list(s)) for i, t, h in zip(*(part[c].to_pylist() for c in ("id", "text", "hide")), strict=True) for s in _sequences(t, h)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in found], pa.int64()), pa.array([s[0] for _, s in found], pa.list_(pa.list_(pa.int32()))), pa.array([s[1] for _, s in found], pa.list_(pa.int32()))],
                    ["id", "rows", "tags"],
                )

    data = texts.withColumn("id", F.col("id").cast("long")).mapInArrow(learn, "id long, rows array<array<int>>, tags array<int>").toArrow().to_pylist()
    field = Field()
    field.fit([(r["rows"], r["tags"]) for r in sorted(data, key=lambda r: (r["id"], r["rows"]))[: 8 * sample]])
    return field


def scan(docs: DataFrame, field: Field, *, text: str = "text", margin: float = 2.0) -> DataFrame:
    """``docs`` with ``spans``: base ones, and those of the field that overlap none."""
    kept = [c for c in docs.columns if c != "spans"]
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def find(t: str | None) -> list[dict]:
        if not t:
            return []
        base = base_spans(t)
        more = [("other", s, e) for s, e in sent.value.spans(t, margin) if all(e <= a or b <= s for _, a, b in base)]
        return [{"kind": k, "start": s, "end": e, "base": k != "other"} for k, s, e in base + more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text):
                rows = pa.array([find(t) for t in part[text].to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], rows], [*kept, "spans"])

    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    return plain.mapInArrow(run, arrays.with_fields(plain.schema, spans=SPANS))
