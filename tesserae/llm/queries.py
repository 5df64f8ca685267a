"""The subpackage's queries and the SQL of those that SQL can express."""

from . import audio, audit, chat, extract, fim, lattice, mixing, neighbours, packing, quality, simhash, substring, urls

QUERIES = {
    "op1_audio": audio.op1_audio,
    "op2_bm25_packing": packing.op2_bm25_packing,
    "op3_link_graph": urls.op3_link_graph,
    "op4_chat_windows": chat.op4_chat_windows,
    "op5_lattice_lm": lattice.op5_lattice_lm,
    "op6_gam": quality.op6_gam,
    "op7_nn_descent": neighbours.op7_nn_descent,
    "op8_golden_mix": mixing.op8_golden_mix,
    "op9_simhash": simhash.op9_simhash,
    "op10_seed_extend": substring.op10_seed_extend,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_block_labeller": extract.op13_block_labeller,
}
ORACLES = {"op4_chat_windows": chat.ORACLE, "op8_golden_mix": mixing.ORACLE, "op10_seed_extend": substring.ORACLE, "op11_filter_audit": audit.ORACLE, "op12_fill_in_middle": fim.ORACLE}
