"""The queries of this package and their SQL twins."""

from emberspark.llm import (decontam, lmscore, neardup, packing, prefixtrie, quality, secrets, sharding, simhash, spelling, topk, toxicity,
                            warc)

MODULES = {"op1_lm": lmscore, "op2_quality": quality, "op3_pack": packing, "op4_neardup": neardup, "op5_secrets": secrets,
           "op6_warc": warc, "op7_topk": topk, "op8_shard": sharding, "op9_toxicity": toxicity, "op10_decontaminate": decontam,
           "op11_simhash": simhash, "op12_trie": prefixtrie, "op13_spelling": spelling}

QUERIES = {name: getattr(module, name) for name, module in MODULES.items()}
ORACLE = {name: sql for module in MODULES.values() for name, sql in module.SQL.items() if sql}
