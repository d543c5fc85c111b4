"""Training-data operators: text, web-page and vector jobs over whole tables.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when the
folder is present.
"""
