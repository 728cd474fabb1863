"""The queries of this subpackage and, where SQL can say them, their SQL."""

from . import alignment, byte_bpe, exact_dedup, fill_middle, image_copies, jaccard_join, license_scan, lm_scoring, packing, quality, sharding, substring_dedup, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_quality": quality.op7_quality,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_image_copies": image_copies.op9_image_copies,
    "op10_packing": packing.op10_packing,
    "op11_alignment": alignment.op11_alignment,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_sharding": sharding.op13_sharding,
}

SQL = {**exact_dedup.SQL, **license_scan.SQL, **url_filter.SQL, **fill_middle.SQL, **sharding.SQL}
