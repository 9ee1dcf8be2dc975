"""Operations of a large training-data pipeline over ``documents`` and ``pages``.

Nothing outside this subpackage imports it. Every operator selects the columns it
needs under names of its own first, so extra or clashing input columns never matter.
"""
