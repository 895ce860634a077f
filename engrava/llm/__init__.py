"""Operators on language-model data: texts, vectors and conversations at corpus scale."""
