"""DataFrame -> DataFrame operators.

ranking     blocked running sums and global ranks (no one-partition window)
tokens      BPE and hashed-piece tokenizing, token statistics
sampling    seeded shuffle, shard, crop/pad, truncation, batch plans, packing report
chat        role routing, chat template, loss mask, conversation training rows
evaluation  next-token pairs, n-gram model, scoring, windows, perplexity, comparison
sequence    linear recurrence (blocked scan), liquid filter, trailing mean,
            causal softmax mean, history attention
vectors     vector lookup and exact inner-product top-k
generation  greedy / temperature decoding and batch generation
"""
