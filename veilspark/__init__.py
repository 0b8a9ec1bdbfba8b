"""Finds secrets and personal data in text and replaces them with stable typed placeholders, on Spark."""
