"""Operators of a training-data pipeline over documents, conversations and pages.

Each module holds one operator; ``queries`` registers one query per operator and
``oracles`` the SQL twins. Nothing outside this subpackage imports it.
"""
