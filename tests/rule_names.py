"""The rules that a table of findings names."""


def rules(findings):
    return sorted(r.rule for r in findings.select("rule").collect())
