"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, htmltext, langid, lmscore, mixing, neardup, passages, pieces, quality, ranked, secrets, tiff, tokens


QUERIES = {
    f.__name__: f
    for f in (
        tokens.op1_feistel_shards,
        tiff.op2_tiff_pages,
        mixing.op3_fair_mix,
        passages.op4_chained_passages,
        langid.op5_kneser_ney,
        pieces.op6_piece_rounds,
        neardup.op7_fast_sketch,
        quality.op8_line_quality,
        htmltext.op9_page_difference,
        secrets.op10_entropy_secrets,
        lmscore.op11_deleted_interpolation,
        ranked.op12_windowed_search,
        audit.op13_filter_audit,
    )
}

ORACLE_SQL = {"op3_fair_mix": mixing.OP3_SQL, "op7_fast_sketch": neardup.OP7_SQL, "op8_line_quality": quality.OP8_SQL, "op12_windowed_search": ranked.OP12_SQL, "op13_filter_audit": audit.OP13_SQL}
