"""Rule deduction and validation over signed RDF-style facts, compiled to Spark DataFrame plans."""

from quadrille.model import (
    Call, Cause, Conclusion, Entailment, Eq, Hypothesis, Lit, Pattern, Reason, Res, Rule, RuleError, Signed, True_, Triple, Validation, Var, negative, positive,
)
from quadrille.operators.deduce import Deductions, EvaluationError
from quadrille.operators.system import System
from quadrille.parser import ParseError, parse_expression, parse_pattern, parse_rule, parse_statement
from quadrille.sources.graph import Graph

__all__ = [
    "Call", "Cause", "Conclusion", "Deductions", "Entailment", "Eq", "EvaluationError", "Graph", "Hypothesis", "Lit", "ParseError", "Pattern", "Reason", "Res",
    "Rule", "RuleError", "Signed", "System", "Triple", "True_", "Validation", "Var", "negative", "parse_expression", "parse_pattern", "parse_rule",
    "parse_statement", "positive",
]
