from chatlake.sources.tables import read_table, register_tables  # noqa: F401
