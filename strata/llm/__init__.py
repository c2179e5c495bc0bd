"""Training-data operators: near-dedup, line dedup, decontamination, URL filters, quality, ANN, BPE, language, toxicity, PII.

Nothing outside this subpackage imports it; ``queries`` registers the operators for the driver.
"""
