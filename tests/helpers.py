def rows_of(frame):
    """Rows as sorted text, columns by name; for comparing results of different engines."""
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))
