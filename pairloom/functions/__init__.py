"""Column functions: narrow, native expressions unless a docstring says otherwise."""
