"""Operators for preparing training text: language, licences, near copies, secrets, leaks, repeats, toxicity,
personal data, source mixing, vector search, conversation tries and spelling variants.  Nothing outside this subpackage imports it."""
