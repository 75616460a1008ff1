"""Secret scans by one deterministic automaton for all rules.

Rules are regular expressions over bytes. All of them together are turned into one automaton by subset construction and
minimisation, whose transitions are a single numpy array. One pass over the bytes tells which rules match where in which
text; only texts with a hit are looked at again, by the hit rule's own small automata, which place its matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from weald.llm.common import fresh, slices, table, tidy


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `head` and `body` matched in a row, of which the body has to have `least` characters.

    Supported: literals, classes, groups, alternatives, greedy repetition. A match is the longest from the leftmost place;
    the next is looked for behind it. Matches with too short a body are dropped, but the search goes on behind them.
    """

    kind: str
    body: str
    head: str = ""
    ignore_case: bool = False
    least: int = 0


#: The base kinds. A maximal run of 24 characters or more is the same as a run of any length that is dropped if shorter.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds, by the publicly documented forms of such tokens. Lengths are checked when matches are placed: counters of
#: many rules, each of which may run within another's match, would multiply the automaton's states.
RULES = (
    *BASE,
    Rule("temporary", r"ASIA[A-Z0-9]+", least=20),
    Rule("private-key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----"),
    Rule("jwt", r"[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", least=8),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("github-pat", r"github_pat_[A-Za-z0-9_]+", least=33),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", least=26),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[A-Za-z0-9]+", r"[rs]k_(live|test)_", least=16),
    Rule("npm", r"npm_[A-Za-z0-9]+", least=40),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]+", least=55),
    Rule("hub", r"hf_[A-Za-z0-9]+", least=33),
    Rule("bearer", r"[A-Za-z0-9._~+/-]+=*", r"Bearer\x20+", True, 20),
    Rule("url", r"[A-Za-z0-9._~%+-]+@", r"://[A-Za-z0-9._~%+-]+:", least=4),
)

#: Stands between texts; no rule may match it, and in UTF-8 it never occurs.
BREAK = 0xFF
#: Chunks that a pass moves through in step, the least length of one, and bytes that a pass takes at a time.
CHUNKS, LEAST_CHUNK, BLOCK = 4096, 64, 8 << 20


class Nfa:
    """States with empty moves and moves on sets of bytes (256-bit integers); built from parsed rules."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def read(self, tree, begin: int, ignore_case: bool, back: bool) -> int:
        """Adds a parsed sequence behind state `begin`, backwards if `back`; returns its last state."""
        for op, what in reversed(list(tree)) if back else tree:
            if op is sre.SUBPATTERN:
                begin = self.read(what[3], begin, ignore_case, back)
            elif op is sre.BRANCH:
                end = self.state()
                for one in what[1]:
                    self.empty[self.read(one, self.branch(begin), ignore_case, back)].append(end)
                begin = end
            elif op is sre.MAX_REPEAT:
                least, most, inner = what
                for _ in range(least):
                    begin = self.read(inner, begin, ignore_case, back)
                if most is sre.MAXREPEAT:
                    loop = self.branch(begin)
                    self.empty[self.read(inner, loop, ignore_case, back)].append(loop)
                    begin = self.branch(loop)
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[begin].append(end)
                        begin = self.read(inner, begin, ignore_case, back)
                    self.empty[begin].append(end)
                    begin = end
            else:
                end = self.state()
                self.moves[begin].append((self.bytes_of(op, what, ignore_case), end))
                begin = end
        return begin

    def branch(self, begin: int) -> int:
        out = self.state()
        self.empty[begin].append(out)
        return out

    @staticmethod
    def bytes_of(op, what, ignore_case: bool) -> int:
        parts = what if op is sre.IN else [(op, what)]
        found = set()
        for kind, value in parts:
            if kind is sre.LITERAL:
                found.add(value)
            elif kind is sre.RANGE:
                found.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"rules can't have {kind}")
        if max(found) >= 128:
            raise ValueError("rules are ASCII")
        if ignore_case:
            found |= {ord(f(chr(c))) for c in found for f in (str.lower, str.upper)}
        return sum(1 << c for c in found)

    def closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)


@dataclass
class Automaton:
    """Complete and minimal. A state is its row's offset in `moves`; 0 is the first. `accepts`: a bit a rule, by offset."""

    kinds: np.ndarray  # of each byte, the column
    moves: np.ndarray
    accepts: np.ndarray
    dead: int  # the state that nothing leads out of, or -1

    @classmethod
    def of(cls, patterns: list[tuple[str, bool]], anywhere: bool, back: bool = False, first_only: bool = False) -> Automaton:
        """Of (pattern, ignore case): after a byte, bit k says that a match of pattern k ends there. `anywhere`: a match
        that begins at any byte before, else at the first one. `back`: for texts read from their end. `first_only`: of
        the matches from a place only the shortest ends, which is enough to tell whether there is one, and takes far fewer
        states where the bodies of many rules may overlap."""
        nfa, ends = Nfa(), {}
        first = nfa.state()
        for k, (pattern, ignore_case) in enumerate(patterns):
            ends[nfa.read(sre_parser.parse(pattern), nfa.branch(first), ignore_case, back)] = k
        masks = sorted({m for moves in nfa.moves for m, _ in moves})
        signature = [tuple(bool(m >> b & 1) for m in masks) for b in range(256)]
        columns = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        kinds = np.array([columns[s] for s in signature], np.int32)
        sample = [signature.index(s) for s in columns]
        # sets of states are integers; what a state leads to by each kind of byte
        closed = [sum(1 << t for t in nfa.closed({s})) for s in range(len(nfa.empty))]
        final = sum(1 << s for s in ends)
        leads = [[0] * len(sample) for _ in closed]
        for s, moves in enumerate(nfa.moves):
            if not (first_only and closed[s] & final):
                for m, t in moves:
                    for c, byte in enumerate(sample):
                        if m >> byte & 1:
                            leads[s][c] |= closed[t]
        moving = sum(1 << s for s, row in enumerate(leads) if any(row)) | final
        start = closed[first] & moving
        if start & final:
            raise ValueError("a rule that matches nothing at all")
        known, rows, todo = {start: 0}, [], [start]
        for now in todo:  # subset construction
            row, left = [start if anywhere else 0] * len(sample), now
            while left:
                low = left & -left
                left ^= low
                for c, after in enumerate(leads[low.bit_length() - 1]):
                    row[c] |= after
            for after in (x & moving for x in row):
                if after not in known:
                    known[after] = len(known)
                    todo.append(after)
            rows.append([known[x & moving] for x in row])
        moves = np.array(rows)
        accepts = np.array([sum(1 << k for s, k in ends.items() if states >> s & 1) for states in known], np.int64)
        # minimisation: classes of states are split by what they accept and where they lead until nothing changes
        group = np.unique(accepts, return_inverse=True)[1]
        while True:
            _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == group.max():
                break
            group = finer
        order = np.full(group.max() + 1, -1)
        for s in range(len(group)):  # in the order they were found, so that the first comes first
            if order[group[s]] < 0:
                order[group[s]] = order.max() + 1
        group = order[group]
        least = np.unique(group, return_index=True)[1]
        width = len(columns)
        table = group[moves[least]]
        stuck = [s for s in range(len(table)) if (table[s] == s).all() and not accepts[least[s]]]
        at = np.zeros(len(table) * width, np.int64)
        at[np.arange(len(table)) * width] = accepts[least]
        return cls(kinds, (table * width).ravel().astype(np.int32), at, stuck[0] * width if stuck else -1)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the bytes behind which a rule matches, and which rules. Memory has the bound of a block."""
        places, flags, state = [], [], 0
        for at in range(0, len(data), BLOCK):
            found = self.states(data[at : at + BLOCK], state)
            state = int(found[-1])
            found = self.accepts.take(found)
            places.append(np.flatnonzero(found) + at)
            flags.append(found[places[-1] - at])
        return (np.concatenate(places), np.concatenate(flags)) if places else (np.empty(0, int), np.empty(0, int))

    def states(self, data: np.ndarray, first: int = 0) -> np.ndarray:
        """The state after each byte, from state `first`. The bytes are cut into chunks that are passed in step, all from the first state;
        a chunk that the one before leaves in another state is passed again until it meets what was found before."""
        n = len(data)
        length = max(LEAST_CHUNK, -(-n // CHUNKS))
        count = -(-n // length)
        padded = np.full(count * length, BREAK, np.uint8)
        padded[:n] = data
        kinds = np.ascontiguousarray(self.kinds[padded].reshape(count, length).T)
        out = np.empty((length, count), np.int32)
        state = np.zeros(count, np.int32)
        for k in range(length):
            state = self.moves.take(state + kinds[k])
            out[k] = state
        before = np.zeros(count, np.int32)  # the state that each chunk has been passed from
        while True:
            came = np.concatenate([[first], out[-1, :-1]]).astype(np.int32)
            at = np.flatnonzero(came != before)
            if not len(at):
                break
            before[at] = came[at]
            state = came[at]
            for k in range(length):
                state = self.moves.take(state + kinds[k, at])
                apart = state != out[k, at]
                if not apart.all():
                    at, state = at[apart], state[apart]
                    if not len(at):
                        break
                out[k, at] = state
        return out.T.ravel()[:n]

    def longest(self, data: bytes, begin: int) -> int:
        """Where the longest match from `begin` ends, or -1."""
        state, end, kinds, moves, accepts = 0, -1, self.kinds, self.moves, self.accepts
        for i in range(begin, len(data)):
            state = moves[state + kinds[data[i]]]
            if state == self.dead:
                break
            if accepts[state]:
                end = i + 1
        return end


class Scanner:
    """All rules as one automaton, and for each rule those that place its matches."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = [(r.head + r.body, r.ignore_case) for r in rules]
        self.all = Automaton.of(whole, anywhere=True, first_only=True)
        self.back = [Automaton.of([p], anywhere=True, back=True) for p in whole]
        self.match = [Automaton.of([p], anywhere=False) for p in whole]
        self.head = [Automaton.of([(r.head, r.ignore_case)], anywhere=False) if r.head else None for r in rules]

    def place(self, k: int, data: bytes, begins: np.ndarray) -> list[tuple[int, int]]:
        """Spans of rule k in one text, of which the places are known where matches begin."""
        rule, out, free = self.rules[k], [], 0
        for begin in begins.tolist():
            if begin >= free:
                free = self.match[k].longest(data, begin)
                body = self.head[k].longest(data, begin) if self.head[k] else begin
                if free - body >= rule.least:
                    out.append((begin, free))
        return out

    def __call__(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule, end) of all matches in order, in code points."""
        found: list[list] = [[] for _ in texts]
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        hits, flags = self.all.hits(np.frombuffer(bytes([BREAK]).join(texts) + bytes([BREAK]), np.uint8))
        rules_of: dict[int, list[int]] = defaultdict(list)
        owners = np.searchsorted(offsets, hits, side="right") - 1
        for k in range(len(self.rules)):
            for i in np.unique(owners[flags >> k & 1 > 0]).tolist():
                rules_of[k].append(i)
        for k, of in rules_of.items():
            data = bytes([BREAK]).join([texts[i] for i in of]) + bytes([BREAK])
            begins = len(data) - 1 - self.back[k].hits(np.frombuffer(data, np.uint8)[::-1])[0][::-1]
            at = 0
            for i in of:
                own = begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + len(texts[i]))] - at
                found[i] += [(begin, k, end) for begin, end in self.place(k, texts[i], own)]
                at += len(texts[i]) + 1
        for i, spans in enumerate(found):
            if spans:
                points = code_points(np.frombuffer(texts[i], np.uint8), sorted({x for b, _, e in spans for x in (b, e)}))
                found[i] = sorted((points[b], k, points[e]) for b, k, e in spans)
        return found


def code_points(data: np.ndarray, places: list[int]) -> dict[int, int]:
    """How many characters of UTF-8 begin before each of the places, which rise."""
    out, last, total = {}, 0, 0
    for at in places:
        for begin in range(last, at, BLOCK):
            total += int(np.count_nonzero((data[begin : min(at, begin + BLOCK)] & 0xC0) != 0x80))
        last = at
        out[at] = total
    return out


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Built once, on the driver; tasks get its arrays."""
    return Scanner(rules)


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def scan_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out_col: str = "secrets") -> DataFrame:
    """df with an array of (kind, start, end) of the secrets in each row's text: code points, end exclusive, by start and
    then the order of rules. The column gets another name where df has one of that name (fresh()).

    Matches of one kind never overlap, those of different kinds may. Null and empty texts have none; repeated rows and an
    empty table are nothing special; further columns pass as they are. A narrow map: texts are read once, whole, and in
    slices of bounded bytes.
    """
    out_col = fresh(df, out_col)
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # whatever their names
    schema = StructType([*plain.schema.fields, StructField("spans", SPANS)])
    at = df.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    scan = scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                spans = [[{"kind": rules[k].kind, "start": b, "end": e} for b, k, e in of] for of in scan(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], [*part.schema.names, "spans"])

    return plain.mapInArrow(tidy(run), schema).toDF(*df.columns, out_col)


def op12_secrets(spark, sf_dir: str) -> DataFrame:
    """scan_secrets over all documents, spans as `kind:start:end`; nulls, empty texts and repeats as there."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def op12_sql() -> str:
    """Every rule by DuckDB's regular expressions; starts from the lengths of what stands before and between matches."""

    def cased(rule: Rule) -> str:
        """Either case of ASCII letters only: a flag would fold others, too."""
        out, inside = "", False
        for c in rule.head:
            inside = inside or c == "["
            out += f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside and not out.endswith("\\") else c
            inside = inside and c != "]"
        return out if rule.ignore_case else rule.head

    parts = []
    for k, rule in enumerate(RULES):
        head = cased(rule)
        pattern, body = f"({head})({rule.body})".replace("'", "''"), f"^({head})".replace("'", "''")
        parts.append(f"""SELECT row, {k} AS rule, '{rule.kind}' AS kind, before + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start, found[i] AS hit
  FROM (SELECT row, found, i, list_sum(list_transform(rest[:i], lambda x: length(x))) AS before
    FROM (SELECT row, regexp_extract_all(txt, '{pattern}') AS found, string_split_regex(txt, '{pattern}') AS rest, unnest(range(1, len(regexp_extract_all(txt, '{pattern}')) + 1)) AS i FROM d))
  WHERE length(regexp_replace(found[i], '{body}', '')) >= {rule.least}""")
    said = "string_agg(kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, rule)"
    few = len(BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS txt FROM documents),
m AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts}, sha256(coalesce({said} FILTER (rule < {few}), '')) AS base_sha256, coalesce({said}, '') AS spans
FROM d LEFT JOIN m USING (row) GROUP BY row, doc_id"""
