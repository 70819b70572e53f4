"""The queries of this subpackage. Those that SQL can't express have no oracle; tests hold them against brute force."""

from __future__ import annotations

from evispark.llm.bpe import op3_bpe
from evispark.llm.collocations import OP12_SQL, op12_collocations
from evispark.llm.decontaminate import op5_decontaminate
from evispark.llm.langid import op9_language_id
from evispark.llm.licenses import op4_license_scan
from evispark.llm.passages import op11_repeated_passages
from evispark.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from evispark.llm.quality_qda import op1_quality_classifier
from evispark.llm.quality_rules import op7_quality_rules
from evispark.llm.secret_scan import op8_secret_scan
from evispark.llm.simhash import op6_simhash
from evispark.llm.sstable import op2_sstable
from evispark.llm.token_counts import op10_token_counts

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sstable": op2_sstable,
    "op3_bpe": op3_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {"op12_collocations": OP12_SQL, "op13_prefix_trie": OP13_SQL}
