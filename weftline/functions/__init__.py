"""Column functions: text, teacher answers, conversations."""
