"""Registered queries of this subpackage and the SQL of those that SQL can express."""
from quillspark.llm import q_decontaminate, q_importance, q_licenses, q_lines, q_lm, q_minhash, q_mixing, q_quality, q_simhash, q_substring, q_toxicity, q_trie, q_urls

QUERIES = {
    "op1_decontaminate": q_decontaminate.op1_decontaminate,
    "op2_lines": q_lines.op2_lines,
    "op3_licenses": q_licenses.op3_licenses,
    "op4_lm": q_lm.op4_lm,
    "op5_simhash": q_simhash.op5_simhash,
    "op6_mixing": q_mixing.op6_mixing,
    "op7_substring": q_substring.op7_substring,
    "op8_toxicity": q_toxicity.op8_toxicity,
    "op9_quality": q_quality.op9_quality,
    "op10_urls": q_urls.op10_urls,
    "op11_importance": q_importance.op11_importance,
    "op12_trie": q_trie.op12_trie,
    "op13_minhash": q_minhash.op13_minhash,
}
ORACLES = {
    "op1_decontaminate": q_decontaminate.SQL,
    "op3_licenses": q_licenses.SQL,
    "op7_substring": q_substring.SQL,
    "op11_importance": q_importance.SQL,
    "op12_trie": q_trie.SQL,
    "op13_minhash": q_minhash.SQL,
}
