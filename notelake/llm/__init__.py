"""Operations of a training-data pipeline: chat formatting, tokenisation, joins, media, language ID, dedup, URL filters, packing.

Nothing else in the library imports this subpackage; its queries are listed in ``registry``.
"""
