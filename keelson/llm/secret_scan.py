"""Secret scan by token efficiency.

A trained vocabulary packs language into few tokens; a random key breaks up into
short ones.  Every long unbroken run of key characters is encoded with a public
tiktoken vocabulary, and a run with few characters per token is reported; of other runs
(a path or name with a key in it) the parts and stretches that have few.  Nothing is
reported that is a known digest (hex of a common digest length) or identifier (UUID, number, version,
or numbers joined by ``_ / -``).  Words pass by their ratio alone.  Three fixed patterns (assignments, access
keys, long hex) are always reported beside it.

Runs inside ``mapInArrow``, one Arrow batch at a time: no shuffle, no state.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_RATIO = 2.0         # characters per token; prose and compound words stay above
MIN_CHARS = 16
# Fixed patterns.  The minimum lengths drop the same matches as a check afterwards would:
# a run is matched from its first character to its last.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CHARS)
KINDS = ("assign", "access", "hex", "random")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
PLAIN_PART = re.compile(r"(?:[vV]?[0-9]+[A-Za-z]?|[0-9+]*)\Z")             # a number, a version; letters are left to the ratio
PART = re.compile(r"[A-Za-z0-9+]+")
HEX_RUN = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")

# Fixed value: the split pattern that goes with the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding of a rank file, read once per worker."""
    if path not in _ENCODINGS:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def is_known(run: str) -> bool:
    """Digests and identifiers: random-looking, or hard on the vocabulary, but no secrets."""
    return (bool(HEX_RUN.match(run)) and len(run) in DIGEST_LENGTHS) or bool(UUID.match(run)) \
        or all(PLAIN_PART.match(x) for x in re.split("[_/-]+", run.rstrip("=")))


def low_parts(run: str, enc, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what has few characters per token in a run: the whole run, or else
    parts of it between ``/ _ -``, or stretches inside parts, of MIN_CHARS and more."""
    if is_known(run):
        return []
    body = run.rstrip("=")
    if len(run) < max_ratio * len(enc.encode_ordinary(run)):
        return [(0, len(run))]
    found = []
    for m in PART.finditer(body):
        part = m[0]
        end = len(run) if m.end() == len(body) else m.end()       # the padding belongs to the last part
        if len(part) < MIN_CHARS or is_known(part):
            continue
        tokens = enc.encode_ordinary(part)
        if len(part) < max_ratio * len(tokens):
            found.append((m.start(), end))
            continue
        edges = [0, *accumulate(len(enc.decode_single_token_bytes(t)) for t in tokens)]    # characters: all are ASCII
        found += [(m.start() + a, m.start() + b) for a, b in stretches(edges, max_ratio) if not is_known(part[a:b])]
    return found


def stretches(edges: list[int], max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of every longest stretch covered by low windows; ``edges`` are the ends of the tokens.

    A window starts at a token and takes the fewest tokens that have MIN_CHARS characters.
    """
    out: list[tuple[int, int]] = []
    j = 0
    for i, start in enumerate(edges):
        while j < len(edges) and edges[j] - start < MIN_CHARS:
            j += 1
        if j == len(edges):
            break
        if edges[j] - start < max_ratio * (j - i):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], edges[j])
            else:
                out.append((start, edges[j]))
    return out


def scan(text: str, enc, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span in order; starts and ends count code points."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS) or not low.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        found += [(m.start() + a, 3, m.start() + b) for a, b in low_parts(m[0], enc, max_ratio)]
    return sorted(found)


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per input row: counts by kind, digest of the base spans, and all spans.

    ``spans`` lists ``kind:start:end`` by start, then kind (assign, access, hex,
    random), comma-joined; ``base_sha256`` is the SHA-256 of that list without the
    random ones.  A null text has no spans (empty list).  Texts are read whole.
    Repeated rows each get their row; extra columns are ignored.
    """
    schema = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
              "n_random long")

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            out = [[] for _ in range(7)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                spans = scan(text, enc, max_ratio) if text else []
                told = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in spans]
                base = ",".join(x for k, x in told if k < 3)
                n = [sum(k == i for k, _ in told) for i in range(4)]
                for col, v in zip(out, (doc_id, *n[:3], hashlib.sha256(base.encode()).hexdigest(),
                                        ",".join(x for _, x in told), n[3])):
                    col.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)],
                                  names=[x.split()[0] for x in schema.split(", ")])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)
