"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidewell.llm.decontamination import op6_decontam, op6_sql
from tidewell.llm.edit_fingerprints import op12_fingerprints
from tidewell.llm.embed_dedup import OP4_SQL, op4_embed_dedup
from tidewell.llm.line_dedup import op9_line_dedup, op9_sql
from tidewell.llm.mixing import op7_mix, op7_sql
from tidewell.llm.periodic_runs import op13_periodic_runs
from tidewell.llm.pii import op1_pii
from tidewell.llm.quality import op2_quality
from tidewell.llm.secrets import op3_secrets
from tidewell.llm.sharding import op10_shard, op10_sql
from tidewell.llm.simhash import op5_simhash
from tidewell.llm.toxicity import op8_toxicity
from tidewell.llm.whitening import op11_whiten

QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_embed_dedup": op4_embed_dedup,
    "op5_simhash": op5_simhash,
    "op6_decontam": op6_decontam,
    "op7_mix": op7_mix,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_shard": op10_shard,
    "op11_whiten": op11_whiten,
    "op12_fingerprints": op12_fingerprints,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {"op4_embed_dedup": OP4_SQL, "op6_decontam": op6_sql(), "op7_mix": op7_sql(), "op9_line_dedup": op9_sql(), "op10_shard": op10_sql()}
