"""Readers that turn folders, logs and ready-made tables into vault frames."""
