"""Column functions over sequences and arrays; Arrow UDFs where an algorithm is sequential."""
