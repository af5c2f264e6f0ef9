"""taskloom.plans"""
