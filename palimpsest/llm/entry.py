"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, jpeg, language, metric_join, mixing, packing, phrases, pii, secrets, sharding, simhash, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_secrets_trigram, warc.op2_warc_dictionary, pii.op3_pii_surrogates, packing.op4_best_fit_packing,
        toxicity.op5_toxicity_segments, mixing.op6_soft_mixing, jpeg.op7_jpeg_thumbnails,
        metric_join.op8_metric_range_join, simhash.op9_simhash_covering, sharding.op10_byte_prefix_shards,
        phrases.op11_phrase_collocations, alignment.op12_tokenizer_alignment, language.op13_language_profiles,
    )
}
ORACLES = {"op2_warc_dictionary": warc.ORACLE, "op8_metric_range_join": metric_join.ORACLE}
