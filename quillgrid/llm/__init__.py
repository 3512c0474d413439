"""Training-data operators: mixing, dedup, private data, secrets, decontamination,
quality, sharding, language, licences, toxicity, ranked search, set joins and filter audits.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
