"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .chat import op4_chat
from .decontamination import op8_decontamination
from .fingerprints import op6_fingerprints
from .language_id import op2_language_id
from .line_dedup import op10_line_dedup
from .mixing import OP13_SQL, op13_mixing
from .near_duplicates import op5_near_duplicates
from .pieces import op9_piece_segmentation
from .spelling import OP12_SQL, op12_spelling_variants
from .token_counts import op7_token_counts
from .token_ids import op1_token_ids
from .warc import op3_warc

_ALL = (
    op1_token_ids, op2_language_id, op3_warc, op4_chat, op5_near_duplicates,
    op6_fingerprints, op7_token_counts, op8_decontamination, op9_piece_segmentation, op10_line_dedup,
    op11_alignment, op12_spelling_variants, op13_mixing,
)
QUERIES = {f.__name__: f for f in _ALL}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_LETTERS}', (1 + ((('0x' || substr(s, {1 + 5 * i}, 5))::bigint >> {15 - 5 * j}) & 31))::int, 1)"
    for i in range(8) for j in range(4)
)
ORACLE_SQL: dict[str, str] = {
    "op12_spelling_variants": OP12_SQL,
    "op13_mixing": OP13_SQL,
    # types, sizes, digests and referrals of WARC records follow from the pages alone
    "op3_warc": f"""
        with p as (select page_id, coalesce(html, '') h from pages),
        d as (select page_id, strlen(h) n, sha1(h) s, min(page_id) over (partition by h) f from p)
        select page_id, n::bigint payload_bytes, {_BASE32} payload_digest,
          case when f = page_id then 'response' else 'revisit' end record_type,
          case when f <> page_id then f end refers_to,
          case when f = page_id then true end digest_verified
        from d""",
}
