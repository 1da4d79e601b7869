"""pseudoflow — corpus-scale PII detection, pseudonymization and restoration on Spark.

Every public operator is ``DataFrame -> DataFrame`` and is built from Spark column
expressions (regex functions, higher-order functions), windows, joins and keyed
streaming state.  See README.md for the operator map.
"""

from pseudoflow.options import MaskOptions
from pseudoflow.functions.rules import RULES, Rule, rule_by_id, rules_for_language, rules_for_level

__all__ = ["MaskOptions", "RULES", "Rule", "rule_by_id", "rules_for_language", "rules_for_level"]
