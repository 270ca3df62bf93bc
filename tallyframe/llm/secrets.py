"""Secret scan: pattern kinds plus a token-efficiency test for random strings.

A tokenizer spends few ids on language and many on random strings, so a candidate whose characters per id
fall below a limit is random. Digests and identifiers of known shape are excluded first; every other run of 20 or more
characters is tested, whatever it is made of. Names made of words need no exclusion: they take few ids.

Null and empty texts have no span. Rows are independent: repeated rows and equal ids each give their own row,
and other columns of the input never matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, keyed_text, slices, table

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Known shapes: digests of the usual lengths in hex, UUIDs, and numbers of 64 bits or of groups, as in dates and serial numbers.
KNOWN = re.compile(
    r"[0-9a-f]{32}|[0-9A-F]{32}|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{56}|[0-9A-F]{56}|[0-9a-f]{64}|[0-9A-F]{64}|[0-9a-f]{96}|[0-9A-F]{96}|[0-9a-f]{128}|[0-9A-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{20}|[0-9]{1,8}(?:[/_-][0-9]{1,8})+"
)
#: Characters per token below which a candidate counts as random. Base64 has about 1.4, random letters 1.7, joined words over 3.
RATIO = 2.2


def encoder(path: str) -> Callable[[str], int]:
    """Counts ids under a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(encoding.encode_ordinary(s))


def is_random(s: str, count: Callable[[str], int], ratio: float = RATIO) -> bool:
    """The token-efficiency test of one candidate."""
    return not KNOWN.fullmatch(s) and len(s) / count(s) < ratio


def find(text: str, count: Callable[[str], int], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """All spans as (start, kind's place in KINDS, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if is_random(m[0], count, ratio)]
    return sorted(out)


def _ranks(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> of every text, in code points, by start and kind."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(_ranks(ranks))
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in slices(batches):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t or "", count, ratio)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    data = keyed_text(df, id_col, text_col)
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from what `scan` found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for found in b.column("spans").to_pylist():
                said = [f"{x['kind']}:{x['start']}:{x['end']}" for x in found]
                n = [sum(x["kind"] == k for x in found) for k in KINDS]
                base = ",".join(s for s, x in zip(said, found, strict=True) if x["kind"] != "token")
                rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), n[3]))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"]
    return spans.mapInArrow(run, f"doc_id {spans.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long")


def redact(df: DataFrame, text_col: str = "text", ranks: str | None = None, ratio: float = RATIO, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, each secret in `text_col` replaced by `mark`; overlapping spans become one. Null stays null."""
    bounded(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(_ranks(ranks))
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                spans, parts, done = find(t, count, ratio) if t else [], [], 0
                for s, _, e in spans:
                    if s >= done:
                        parts += [t[done:s], mark]
                    done = max(done, e)
                out.append("".join(parts) + t[done:] if spans else t)
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(run, df.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


_KINDS = (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))


def _found_sql(n: int, name: str, pattern: str, group: int, least: int) -> str:
    """Matches of one kind: their places follow from the lengths of what lies between them."""
    return f"""
    select doc_id, {n} as kind, '{name}:' || (z - length(whole)) || ':' || z as said, z - length(whole) as start from (
      select doc_id, i, w[i] as whole, g[i] as part, list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))) as z
      from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as w, regexp_extract_all(t, '{pattern}', {group}) as g, regexp_split_to_array(t, '{pattern}') as s from d), unnest(range(1, len(w) + 1)) as u(i)
    ) where length(part) >= {least}"""


#: The base columns by DuckDB.
BASE_ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(_found_sql(n, *k) for n, k in enumerate(_KINDS))}),
a as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, string_agg(said, ',' order by start, kind) as said from f group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(said, '')) as base_sha256 from d left join a using (doc_id)
"""


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 says of the base kinds, without the method's spans."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
