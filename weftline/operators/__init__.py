"""DataFrame operators: sampling, explode, joins, language dimensions."""
