"""The registered queries of this subpackage and their SQL, where SQL can express them."""

import corpus_pipeline
from sparkmine.llm.fingerprints import op5_fingerprints
from sparkmine.llm.langid import op10_language_id
from sparkmine.llm.mixing import OP6_SQL, op6_mixing
from sparkmine.llm.neighbours import op8_nearest
from sparkmine.llm.packing import op3_packing
from sparkmine.llm.pii import op9_pii
from sparkmine.llm.secrets import op4_secret_scans
from sparkmine.llm.simhash import op7_simhash
from sparkmine.llm.token_files import op1_token_files
from sparkmine.llm.urls import op2_url_filters

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_url_filters": op2_url_filters,
    "op3_packing": op3_packing,
    "op4_secret_scans": op4_secret_scans,
    "op5_fingerprints": op5_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_nearest": op8_nearest,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {"op6_mixing": OP6_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
