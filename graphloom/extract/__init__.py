"""Deterministic extraction of facts from source artifacts: every extractor turns files (file_name, text) into rows."""
