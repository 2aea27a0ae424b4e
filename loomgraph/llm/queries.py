"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

import corpus_pipeline
from loomgraph.llm import chat, exact, interactions, langid, licenses, mixing, ordermin, packing, pii, repeats, simhash, tokenfiles, turnrepair

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii_pseudonyms": pii.op1_pii_pseudonyms,
    "op2_language_id": langid.op2_language_id,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_simhash_components": simhash.op5_simhash_components,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_order_minhash": ordermin.op7_order_minhash,
    "op8_packing": packing.op8_packing,
    "op9_suffix_dedup": repeats.op9_suffix_dedup,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_filter_interactions": interactions.op11_filter_interactions,
    "op12_structure_repair": turnrepair.op12_structure_repair,
    "op13_token_files": tokenfiles.op13_token_files,
}

ORACLE = {
    "op3_mixing": mixing.ORACLE,
    "op4_exact_dedup": exact.ORACLE,
    "op6_license_scan": licenses.oracle_sql(),
    "op10_chat_formatting": chat.ORACLE,
    "op11_filter_interactions": interactions.ORACLE,
    "op12_structure_repair": turnrepair.ORACLE,
}
